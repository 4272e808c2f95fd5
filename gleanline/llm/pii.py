"""Problem 5: find personal information in free text and put typed placeholders in its place."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import LOOK
from .pii_training import FIRST_NAMES, GERMAN, ORDINARY, TITLES, training_sentences

KINDS = ["O", "email", "phone", "id_number", "address", "name"]
K = len(KINDS)
DIMENSIONS = 1 << 16
#: Weights of the edges between equal words of one document: both of one kind, both nothing, or not alike.
SKIP_SAME, SKIP_PLAIN, SKIP_APART = 6.0, 0.5, 0.0
MESSAGE_ROUNDS = 6
POSSIBLE = {kind: np.array([0.0 if k == 0 or KINDS[k] in labels else -50.0 for k in range(K)]) for kind, labels in {"email": {"email"}, "handle": (), "code": {"id_number"}, "number": {"phone", "id_number"}, "word": {"address", "name"}, "mark": {"address", "name"}}.items()}

# Runs begin at their border and are taken whole, so that long runs of one kind of character cost no more than their length.
EMAIL = r"(?<![\w.+-])[\w.+-]++(?:@|\s?\((?i:at)\)\s?|\s?\[(?i:at)\]\s?)[\w-]++(?:(?:\.|\s?\[(?i:dot)\]\s?|\s?\((?i:dot)\)\s?)[\w-]++)+|(?<![\w.+-])[\w.+-]++ (?i:at) [\w-]++(?: (?i:dot) [\w-]++)+"
NUMBER = r"(?:\+|00)?\(?\d(?:[().\-/ ]{0,3}\d)++"
#: A longer run of digits is several numbers: it is cut at its blanks.
NUMBER_DIGITS = 20
STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Terrace|Close|Crescent|Parkway|Way|Hill|Row)"
CAP = r"[A-Z][\w'’-]*+"
ADDRESS = re.compile(
    rf"""(?:(?:Apt|Apartment|Flat|Unit|Suite|Ste)\.?\ \d+\w?,?\ )?\d{{1,5}}[a-zA-Z]?\ (?:{CAP}\ ){{1,3}}{STREET}\b\.?(?:,\ (?:\d{{4,5}}\ )?{CAP}(?:\ {CAP}){{0,3}}(?:\ \d{{4,5}})?)?
    |(?:Apt|Apartment|Flat|Unit|Suite|Ste)\.?\ \d+\w?,\ (?:{CAP}\ ){{1,3}}{STREET}\b\.?(?:,\ {CAP}(?:\ {CAP}){{0,3}}(?:\ \d{{4,5}})?)?
    |(?:Calle|Avenida|Av\.|Plaza|Paseo|Camino|Via|Viale|Rua)\ (?:de\ la\ |de\ |del\ )?(?:{CAP}\ ){{1,3}}\d{{1,4}}[a-z]?\b(?:,\ (?:\d{{4,5}}\ )?{CAP}(?:\ {CAP}){{0,3}})?
    |P\.?O\.?\ Box\ \d{{1,6}}(?:,\ {CAP}(?:\ {CAP}){{0,3}}(?:\ \d{{4,5}})?)?
    |\d{{1,4}}(?:\ ?bis)?,?\ (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée)\ (?:de\ la\ |de\ |du\ |des\ )?{CAP}(?:\ {CAP}){{0,3}}(?:,\ (?:\d{{4,5}}\ )?{CAP}(?:\ {CAP}){{0,3}})?
    |(?<!\w)(?:{CAP}\ ){{0,3}}(?<!\w)[A-Z][\w'’-]*(?:\ Str(?:\.|aße|asse)|\ Weg|\ Platz|\ Allee|\ Gasse|str\.|straße|strasse|weg|platz|allee|gasse)\ \d{{1,4}}\ ?[a-z]?\b(?:,\ (?:\d{{4,5}}\ )?{CAP}(?:\ {CAP}){{0,3}})?""",
    re.VERBOSE,
)
TOKEN = re.compile(rf"(?P<email>{EMAIL})|(?P<handle>(?<!\w)/?u/\w+|(?<![\w.])@\w+)|(?P<code>\b[A-Z]{{2}}\d\d(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?\b|\b[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-Z]\b|\b[A-Z]{{1,2}}\d{{6,8}}\b|\b\d{{8}}-?[A-Z]\b)|(?P<number>(?<![\w.$]){NUMBER}(?!\w))|(?P<word>[^\W_]+(?:['’-][^\W_]+)*)|(?P<mark>[^\w\s])", re.UNICODE)
ID_WORDS = frozenset("passport ssn social security insurance nino tax tin dni nif nie iban steuer id national identity identification licence license number no nr".split())
PHONE_WORDS = frozenset("call ring text phone tel telephone mobile cell whatsapp line fax dial reach contact sms number hotline".split())
PRODUCT = re.compile(r"(?:crest|mint|dock|loop|stack|board|kiln|wick|cast|vane|spire|pulse|moss|nest|grid|fold|forge|tally|lane|bay|desk|ly|trail|beam|port|hub|lab|pad|talk|ops|crm|app|soft|ware|suite|base)$")
INITIAL_NAME = re.compile(r"(?<![\w.])[A-Z]\.\s?(?:[A-Z]\.\s?)?(?:O['’]|Mc|Mac|de |van |von )?[A-Z][a-z]")
#: A capitalised word inside a sentence, or two at its start: a name, unless the field finds that it is none.
CAPITALISED = re.compile(r"(?<=\S )[A-ZÀ-ÖØ-Þ][a-zà-ÿ][\w'’-]*|^[A-ZÀ-ÖØ-Þ][a-zà-ÿ][\w'’-]* [A-ZÀ-ÖØ-Þ][a-zà-ÿ]")
TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\b\.?\s[A-Z]")
MORE_EVIDENCE = re.compile(r"@|\(at\)|\[at\]| at [\w-]+ dot |\b[A-Z]{1,2}\d{6,8}\b|\b[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]\b|\b\d{8}-?[A-Z]\b|\b\d{3}-\d{2}-\d{4}\b|(?:\d[ .()/+-]*){7,}|\bP\.?O\.? Box \d|\b[A-Z]{2}\d\d ?[A-Z0-9]{4} ?[A-Z0-9]{4}", re.I)
#: Sentences end at a line end, or at a mark that doesn't close an initial, a title or an abbreviation.
SENTENCE_END = re.compile(r"\n+|(?<=[.!?])(?<!\b[A-Z]\.)(?<!\bMr\.)(?<!\bMs\.)(?<!\bMrs\.)(?<!\bDr\.)(?<!\bProf\.)(?<!\bno\.)(?<!\bNo\.)(?<!\bSt\.)(?<!\bStr\.)(?<!\bAve\.)(?<!\bRd\.)(?<!\bApt\.)\s+(?=\S)")


@lru_cache(maxsize=400_000)
def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (DIMENSIONS - 1)


def shape_of_number(text: str) -> str:
    groups = re.findall(r"\d+", text)
    return ("+" if text[0] == "+" else "00" if text.startswith("00") else "(" if "(" in text else "") + "-".join(str(len(g)) for g in groups)


class Token:
    __slots__ = ("start", "end", "text", "kind", "low", "address")

    def __init__(self, start: int, end: int, text: str, kind: str, address: bool):
        self.start, self.end, self.text, self.kind, self.low, self.address = start, end, text, kind, text.lower(), address


def tokens_of(sentence: str, offset: int = 0) -> list[Token]:
    spans = [m.span() for m in ADDRESS.finditer(sentence)]
    out, at = [], 0
    inside = lambda i: any(a <= i < b for a, b in spans)
    while m := TOKEN.search(sentence, at):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "number" and inside(start):  # house numbers and codes of an address stay apart
            piece = re.compile(r"\d+\w?").match(sentence, start) or m
            kind, end = "word", max(piece.end(), start + 1)
        elif kind == "number" and sum(c.isdigit() for c in m.group()) < 7:
            piece = re.compile(r"\d+|\(|\+").match(sentence, start) or m
            kind, end = "word", max(piece.end(), start + 1)
        elif kind == "number" and sum(c.isdigit() for c in m.group()) > NUMBER_DIGITS:
            piece = re.compile(r"[^ ]++(?: [^ ]++)?(?: [^ ]++)?").match(sentence, start, end)
            end = piece.end()
        out.append(Token(offset + start, offset + end, sentence[start:end], kind, inside(start)))
        at = end
    return out


def is_name_like(t: Token) -> bool:
    return t.kind == "word" and t.text[:1].isupper() and any(map(str.islower, t.text)) and not PRODUCT.search(t.low)


def features(tokens: list[Token]) -> list[list[int]]:
    """Hashed features of every token of a sentence."""
    own: list[list[str]] = []
    capital = "capde" if any(t.low in GERMAN for t in tokens) else "cap"
    for t in tokens:
        f = [t.kind]
        if t.kind == "word":
            first = t.low in FIRST_NAMES
            f.append("first" if first else "title" if t.text.rstrip(".") in TITLES else "initial" if len(t.text) == 1 and t.text.isupper() else "product" if PRODUCT.search(t.low) and t.text[:1].isupper() else "digits" if t.text[:1].isdigit() else ("capword" if t.low in ORDINARY else capital) if t.text[:1].isupper() else "low")
            if f[1] in ("cap", "capde", "first"):
                f += ["end=" + t.low[-3:], "begin=" + t.low[:2], "shout" if t.text.isupper() and len(t.text) > 1 else "written"]
            if t.low in ID_WORDS:
                f.append("idword")
            if t.low in PHONE_WORDS:
                f.append("phoneword")
        elif t.kind == "number":
            f += ["shape=" + shape_of_number(t.text), f"digits={sum(map(str.isdigit, t.text))}", "sep=" + "".join(sorted({c for c in t.text if not c.isdigit()}))]
            f.append(f"{f[1]}|{all(g.endswith('00') for g in re.findall(r'\d+', t.text))}")
        elif t.kind == "mark":
            f.append("m=" + t.text)
        if t.address:
            f.append("addr")
        own.append(f)
    out = []
    low = [t.low if t.kind in ("word", "mark") and not t.text[:1].isdigit() else t.kind for t in tokens]
    word = lambda i: low[i] if 0 <= i < len(low) else "<>"
    cls = lambda i: own[i][1] if 0 <= i < len(own) and len(own[i]) > 1 else own[i][0] if 0 <= i < len(own) else "<>"
    for i, t in enumerate(tokens):
        base = own[i]
        f = [*base, *(f"{base[0]}|{x}" for x in base[1:])]
        me = base[1] if len(base) > 1 else base[0]
        f += [f"{me}|-1{cls(i - 1)}", f"{me}|+1{cls(i + 1)}", f"{me}|-2{cls(i - 2)}|-1{cls(i - 1)}", f"{me}|+1{cls(i + 1)}|+2{cls(i + 2)}", f"{me}|-1{cls(i - 1)}|+1{cls(i + 1)}"]
        if t.kind != "mark":
            f += [f"{base[0]}|w-1{word(i - 1)}", f"{base[0]}|w-2{word(i - 2)}", f"{base[0]}|w-3{word(i - 3)}", f"{base[0]}|w+1{word(i + 1)}"]
        if t.kind == "number":
            near = [word(j) for j in range(i - 5, i + 4)]
            f += ["near-id"] * any(w in ID_WORDS and w not in ("number", "no", "nr") for w in near) + ["near-phone"] * any(w in PHONE_WORDS for w in near)
        if t.kind == "word" and me == "low":
            f.append("low=" + t.low)
        if t.address:
            f += [f"addr|{me}"]
        out.append([bucket(x) for x in f])
    return out


class Model:
    """A skip-chain conditional random field, trained piecewise.

    Node weights are a multinomial regression over hashed features, chain potentials the
    smoothed log-ratios of neighbouring labels, both from generated, labelled sentences. In
    a document equal rare words (a surname, a number) are joined in a hub, and loopy
    message passing lets a clear mention decide about all unclear ones, near or far.
    """

    def __init__(self, seed: int = 7, sentences: int = 14_000, epochs: int = 6):
        rng = np.random.default_rng(seed)
        flat, starts, labels = [], [0], []
        pair = np.ones((K, K))
        single = np.full(K, float(K))
        for text, spans in training_sentences(rng, sentences):
            tokens = tokens_of(text)
            tags = [next((KINDS.index(k) for a, b, k in spans if a <= t.start < b), 0) for t in tokens]
            for f, tag in zip(features(tokens), tags):
                flat += f
                starts.append(len(flat))
                labels.append(tag)
            for a, b in zip(tags, tags[1:]):
                pair[a, b] += 1
            for a in tags:
                single[a] += 1
        flat, starts, labels = np.array(flat), np.array(starts), np.array(labels)
        self.weights = np.zeros((DIMENSIONS, K), np.float64)
        grown = np.full((DIMENSIONS, K), 1e-6)
        n = len(labels)
        for epoch in range(epochs):
            order = rng.permutation(n)
            for part in np.array_split(order, max(1, n // 2000)):
                idx = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part])
                owner = np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
                cells = flat[idx]
                z = np.zeros((len(part), K))
                np.add.at(z, owner, self.weights[cells])
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), labels[part]] -= 1
                used, back = np.unique(cells, return_inverse=True)
                g = np.zeros((len(used), K))
                np.add.at(g, back, p[owner])
                g = g / len(part) + 1e-6 * self.weights[used]
                grown[used] += g**2
                self.weights[used] -= 0.15 * g / np.sqrt(grown[used])
        expected = np.outer(single, single) / single.sum()
        self.chain = 0.5 * np.clip(np.log(pair / pair.sum() * single.sum() / (expected / single.sum()) / single.sum()), -3, 3)
        self.skip = np.full((K, K), SKIP_APART)
        np.fill_diagonal(self.skip, SKIP_SAME)
        self.skip[0, 0] = SKIP_PLAIN

    def nodes(self, tokens: list[Token]) -> np.ndarray:
        cells = features(tokens)
        if not cells:
            return np.zeros((0, K))
        starts = np.cumsum([0, *map(len, cells[:-1])])
        node = np.add.reduceat(self.weights[[c for f in cells for c in f]], starts)
        # a label needs a token of its form
        return node + np.array([POSSIBLE[t.kind] for t in tokens])

    def decode(self, sentences: list[list[Token]]) -> list[np.ndarray]:
        """Labels of every token of the sentences of one document, by loopy max-product messages."""
        node = [self.nodes(s) for s in sentences]
        where: dict[str, list[tuple[int, int]]] = {}
        for s, tokens in enumerate(sentences):
            for i, t in enumerate(tokens):
                if t.kind in ("number", "code", "email") or is_name_like(t) and len(t.text) > 2:
                    where.setdefault(t.low, []).append((s, i))
        # the mentions of a word meet in one hub, which keeps the edges linear and any two mentions two edges apart
        groups = [places for places in where.values() if len(places) > 1]
        if not groups:
            return [self.viterbi(n) for n in node]
        from_hub = [np.zeros((len(places), K)) for places in groups]

        def beliefs() -> list[np.ndarray]:
            belief = [n.copy() for n in node]
            for places, messages in zip(groups, from_hub):
                for (s, i), message in zip(places, messages):
                    belief[s][i] += message
            return belief

        for _ in range(MESSAGE_ROUNDS):
            marginal = [self.max_marginals(n) for n in beliefs()]
            change = 0.0
            for g, places in enumerate(groups):
                own = np.array([marginal[s][i] for s, i in places]) - from_hub[g]
                to_hub = passed(own, self.skip)
                # a mention hears the clearest other one, so that many unclear ones don't add up
                clear = np.argsort(to_hub[:, 0] - to_hub[:, 1:].max(1), kind="stable")
                others = np.repeat(to_hub[clear[:1]], len(places), axis=0)
                others[clear[0]] = to_hub[clear[1]]
                new = 0.5 * from_hub[g] + 0.5 * others
                change = max(change, float(np.abs(new - from_hub[g]).max()))
                from_hub[g] = new
            if change < 1e-3:
                break
        return [self.viterbi(n) for n in beliefs()]

    def viterbi(self, node: np.ndarray) -> np.ndarray:
        n = len(node)
        if n == 0:
            return np.empty(0, int)
        score, back = node[0], np.zeros((n, K), int)
        for i in range(1, n):
            step = score[:, None] + self.chain
            back[i] = step.argmax(0)
            score = step.max(0) + node[i]
        out = np.empty(n, int)
        out[-1] = score.argmax()
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def max_marginals(self, node: np.ndarray) -> np.ndarray:
        n = len(node)
        forward, backward = node.copy(), np.zeros_like(node)
        for i in range(1, n):
            forward[i] += (forward[i - 1][:, None] + self.chain).max(0)
        for i in range(n - 2, -1, -1):
            backward[i] = (self.chain + (node[i + 1] + backward[i + 1])[None]).max(1)
        return forward + backward

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the personal information in ``text``, in order."""
        if not text:
            return []
        if text.isascii() or all(len(LOOK[ord(c)]) == 1 for c in set(text)):
            seen, place = text.translate(LOOK), None
        else:
            # compatibility forms and look-alikes are read as what they look like
            shown = [LOOK[ord(c)] for c in text]
            seen = "".join(shown)
            place = np.repeat(np.arange(len(text)), [len(s) for s in shown])
        found = self._spans(seen)
        if place is None:
            return found
        return [(int(place[a]), int(place[b - 1]) + 1, k) for a, b, k in found]

    def _spans(self, text: str) -> list[tuple[int, int, str]]:
        pieces, at = [], 0
        for m in SENTENCE_END.finditer(text):
            pieces.append((at, text[at : m.start()]))
            at = m.end()
        pieces.append((at, text[at:]))
        marked = [evident(s) for _, s in pieces]
        if not any(marked):
            return []
        chosen = [tokens_of(s, a) if m else None for m, (a, s) in zip(marked, pieces)]
        # sentences that repeat a name-like word of an evident one are read with it
        rare = {t.low for tokens in chosen if tokens for t in tokens if is_name_like(t) and len(t.text) > 3}
        for k, (a, s) in enumerate(pieces):
            if chosen[k] is None and not rare.isdisjoint(w.lower() for w in re.findall(r"(?<!^)\b[A-Z][\w'’-]+|^[A-Z][\w'’-]+", s)):
                chosen[k] = tokens_of(s, a)
        sentences = [c for c in chosen if c]
        out = []
        for tokens, tags in zip(sentences, self.decode(sentences)):
            i = 0
            while i < len(tokens):
                j = i
                while j < len(tokens) and tags[j] == tags[i]:
                    j += 1
                if tags[i]:
                    a, b = i, j
                    while a < b and tokens[a].kind == "mark":
                        a += 1
                    while b > a and tokens[b - 1].kind == "mark":
                        b -= 1
                    if a < b:
                        out.append((tokens[a].start, tokens[b - 1].end, KINDS[tags[i]]))
                i = j
        return sorted(out)


def passed(scores: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Max-product messages of rows of label scores over an edge, the best label at 0."""
    out = (scores[:, :, None] + edge).max(1)
    return out - out.max(1, keepdims=True)


def evident(sentence: str) -> bool:
    """Whether a sentence holds anything that can be personal information: what the field can only find nothing in is not labelled."""
    if any(not PRODUCT.search(w.lower()) for w in CAPITALISED.findall(sentence)):
        return True
    digits = DIGIT.search(sentence) is not None
    if (digits or "@" in sentence or "at" in sentence or "AT" in sentence) and MORE_EVIDENCE.search(sentence):
        return True
    if not FIRST_NAMES.isdisjoint(LETTERS.findall(sentence.lower())):
        return True
    return bool(INITIAL_NAME.search(sentence) or TITLED.search(sentence) or digits and ADDRESS.search(sentence))


DIGIT, LETTERS = re.compile(r"\d"), re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model()


PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS[1:]}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], PLACEHOLDER[k]]
            at = b
    return "".join([*out, text[at:]])


def personal_information(texts: DataFrame, keep: list[str], text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``keep`` columns, ``redacted`` (the text with placeholders) and ``kinds`` (sorted, distinct).

    Method: a skip-chain conditional random field (see ``Model``) over tokens in which
    addresses of mail, numbers and codes are single tokens. Sentences without any evidence
    are not labelled; those that repeat a name-like word of an evident sentence are. The
    model is trained on sentences generated from a seed, once per driver, and broadcast; its
    size is fixed (65,536 features by 6 labels).

    Defined cases: a null text stays null with no kinds; empty and blank texts stay as they
    are; text around a placeholder isn't changed; look-alike characters are read as what
    they look like; texts of any length are read whole; the same text always gives the same
    result.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model or trained())
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep), "redacted string", "kinds array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            redacted, kinds = [], []
            for text in batch.column(len(keep)).to_pylist():
                spans = m.spans(text) if text else []
                redacted.append(redact(text, spans) if spans else text)
                kinds.append(sorted({k for _, _, k in spans}))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(redacted, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=[*keep, "redacted", "kinds"])

    return texts.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
