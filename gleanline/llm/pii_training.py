"""Generated, labelled sentences for the training of the personal-information model.

All content is invented from syllables and a seed. A sentence is text with the spans of its
personal information; as many sentences have none but things that look like it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Given names of many languages and titles.
FIRST_NAMES = frozenset("""
    adam ahmed aisha alejandro alex alice alicia amara amelie amir ana anders andrea anna antonio ava ben bethany bjorn boris bruno
    camille carla carlos carmen charlotte chiara chloe clara claire daniel daria david derrick dieter diego dmitri eduardo elena
    elif emil emily emma erik eva ezra fatima felix fiona francesca frank freya gabriel giulia greta gregor hana hannah hans hassan
    heidi helena henrik hugo ian ilse ines ingrid irina isabel ivan jack jakob james jan jane javier jean joana johan john jonas jose
    julia jürgen karim karl katarina kenji klara kofi laila lars laura leila lena liam linda linnea lucas lucia luis magnus malcolm
    marco marcus maria marie marta martin matteo mei michael miguel mohammed monika nadia naomi nina noah nora olga oliver omar oscar
    owen pablo patricia patrick paul pedro peter petra pierre priya rafael rahul raj renee renée ricardo robert rosa ruth samuel sara sarah
    sean simon sofia sonia sophie søren soren stefan sven tanja tariq terrence theo thomas tobias tomas tom ulrike valentina vera victor viktor
    wanda wei william xavier yara yasmin yuki yusuf zara zoe
""".split())  # fmt: skip
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Mme", "Monsieur", "Madame"]
ONSETS = "b br c d dr f fr g gr h j k kl l m n p pr qu r s st t th v w y z sz th wr cor fj kj vel pel gar mar".split()
MIDDLES = "a e i o u ae ei ar er or an en in el il ol ur".split()
ENDS = "by ow ard ton ley quist berg dale mann ova ska ez well worth stone ham wick-end field lund gate ström low rne ert ande ins ers iano ell etti arr ish mora ford hart son gast ham lunt era ona".split()
PRODUCT_ENDS = "crest mint dock loop stack board kiln wick cast vane spire pulse moss nest grid fold forge tally lane bay desk ly trail beam port".split()
STREETS = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Boulevard", "Blvd", "Drive", "Court", "Place", "Square", "Terrace", "Close"]
TOWN_WORDS = ["Port", "Norwick", "Kestrel", "Lower", "Upper", "East", "Saint", "New"]
DOMAINS = ["example.com", "example.org", "example.net", "mail.example", "post.invalid", "corp.test", "shop.example.org", "studio.example.com"]

# Ordinary words that begin with a capital in names of things, days, places and headings.
ORDINARY = frozenset("""
    street avenue road lane drive court place square terrace boulevard close park bridge station market house city town
    sales team support desk customer success product marketing finance legal growth design engineering operations human resources data science research quality assurance help office board group company
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december spring summer autumn winter christmas easter
    project alpha beta open source cloud web mobile app store machine learning artificial intelligence terms service privacy policy user guide getting started read more best practices top ways reasons case study white paper
    united states kingdom new york london paris berlin madrid america europe germany france spain english german french spanish north south east west street journal times post capital bank university college school hospital
    google microsoft apple amazon slack excel word windows linux sheets drive docs zoom stripe shopify python java black white red blue green first last next one two three big small good great question thanks hello dear please
    late early daily weekly monthly everyone anyone someone nothing everything pros cons note notes warning update fyi psa rant
    api crm sql csv pdf seo roi kpi saas faq hr it ceo cto cfo vp pm edit update tldr op version release build ticket order invoice section chapter part page table figure
""".split())  # fmt: skip
# Small words that tell German, in which all nouns begin with a capital.
GERMAN = frozenset("der die das den dem des und ist nicht wir ein eine einen einem einer mit auf für von zu im ist war sind hat haben unser unsere mein meine sich auch aber nach bei seit wurde zum zur".split())
#: Words of random frames.
POOL = "we they it you he she had have got took made saw met asked told gave sent left came went said wrote signed showed knew liked hired paid helped joined fixed called thought that this with from about because when after before while until and or but so if then who which our their his her my your lunch meeting contract invoice office account report demo refund plan price week morning person manager owner friend cousin client charge end still never always only also very quite again today yesterday later agreed answered arrived waiting working in at on by for to of the a an was were is are will would can could did not".split()
GERMAN_POOL = "wir ich er sie haben hat hatte war ist wurde gestern heute morgen dann aber und mit von bei nach seit für der die das den dem ein eine einen nicht auch nur noch schon sehr gut alt neu kam ging sagte schrieb meinte rief antwortete".split()
GERMAN_NOUNS = "Firma Team Lager Kunde Kunden Rechnung Vertrag Monat Woche Jahr Angebot Problem Lösung Preis Zugang Konto Bericht Frage Antwort Werkzeug Abteilung Leitung Kollege Chef Büro Termin Liste Datei Anruf Bestellung Glück Ende Anfang Hilfe Seite Plan Projekt Geld Zeit".split()

# Frames of our own, in the languages the corpus may hold.
BEFORE = {
    "email": ["You can email me at {}", "Send it over to {} whenever you like", "my address is {}", "Forward the thread to {}", "cc {}", "I am easiest to get hold of on {}", "Questions go to {}", "{} is the account I check most", "E-mail: {}", "Schreib mir an {}", "écris-moi à {}", "mi correo es {}", "It bounced from {} twice", "also {}", "or {}", "write {} instead", "{}"],
    "phone": ["My number is {}", "Give me a ring on {} tomorrow", "You can reach us at {}", "Telephone: {}", "Mobile no. {}", "The hotline {} was busy", "Text me on {} if it breaks", "Signal or WhatsApp {}", "Ruf mich an: {}", "mon numéro est le {}", "llámame al {}", "fax {}", "also {}", "or {}", "dial {} and wait", "call {} after five", "{}"],
    "id_number": ["They keep my {} on file", "Somebody leaked my {}", "The portal shows my {} to everyone", "please verify {} for me", "I typed {} into the chat", "Why would a vendor need my {}", "he read out {} on the call", "also {}", "or {}", "my {} was on the scan", "Copy of {} attached", "{}"],
    "address": ["Send the parcel to {}", "Our office is located at {}", "We are based at {} these days", "deliver to {}", "You will find me at {}", "The shop on {} is ours", "Wir sitzen in der {}", "nous sommes au {}", "estamos en {}", "Bill to: {}", "The van stops at {} on Mondays", "also {}", "or {}", "Return labels say {}", "{}"],
    "name": ["I had a call with {}", "{} replied this morning", "my boss {} said no", "Cheers, {}", "Sincerely, {}", "talk to {} in support", "written by {}", "{} here", "I spoke with {} yesterday", "{} signed it", "{} emailed me from the office", "{} sent the invoice twice", "My colleague {} likes it", "according to {} it works", "Danke, {}", "Merci, {}", "Saludos, {}", "I met {} at a fair", "also {}", "or {}", "{}"],
}
NOTHING = [
    "The host {ip} stopped answering after build {d2}.{d1}.{d5}", "Release {d1}.{d2}.{d4} broke the sync, case {d4}-{d4} is open", "Since {date} we saw {d3} failures in {d4} calls", "Plans start at ${d4} for {d2} people", "About {d2}% of {d4} visitors came back", "Case {d7} is a copy of {d7}",
    "Bill {year}-{d4}-{d5} lists {d1},{d3},{d3} views", "Choose {round} users", "the range {round} applies", "tiers of {round} seats", "steps {round} and up", "Windows {d2}.{d1}.{d5}.{d4} is installed", "runs on version {d2}.{d1}.{d5}.{d4}", "{round} is the ladder of our prices", "Item {AA}-{d4}-{d2} is out of stock, {AA}-{d4}-{d2} is not", "Revision {hex} made it slow", "ask u/{Cap}{Cap} or u/{Cap}{Cap}", "ping @{low} on the board", "{First} Software and {First} Labs are vendors", "{First} Suite was cheaper than {First} Cloud",
    "Five Reasons to Love Station Road Bakeries is our worst article", "We drive down the same road each week", "an @ in the name is fine", "{Prod} beats {Prod} at search", "We moved from {Prod} {Prod} to {Prod} ({d5})", "{Prod}, {Prod}: {d5}", "Is there anything like {Prod} for shops?", "The {Prod} wizard hides every option",
    "{Prod} logs me out each hour", "In {Month} the team dropped {Prod}", "Parcel {d4}-{d4}-{d4} arrived", "Shipment {d3}-{d7}-{d7} is lost", "The {Cap} Street Journal quoted {Cap} Lane Capital", "See part {d1}.{d1}.{d2}", "Job {d10} passed", "Cheers, your whole crew", "Ask the front office", "My boss said no", "Call me old fashioned, text is fine", "We are based on {Prod}",
    "Send it to the help desk", "The van stops at noon", "None given", "only {Prod}", "{Prod} for {Prod}", "Run A. B. tests first", "Option B. Costs less", "Grade C. Then again", "Die Firma nutzt {Prod} im Lager", "Unser Team und der Support fanden {Prod} gut", "Notre équipe utilise {Prod}", "La empresa usa {Prod}", "The Sales Team met the Support Desk", "Customer Success and Product Marketing disagree",
    "Black Friday and Cyber Monday were slow", "Project Alpha shipped in {Month}", "Google Sheets and Excel are fine", "Open Source is great", "United States and New York prices differ", "Machine Learning is not magic", "Terms Of Service apply", "Does {Prod} have an API", "Our CRM is slow", "Great Question, Thanks", "Getting Started With {Prod}",
]
FILLERS = ["It was cheap but the accounts people left", "For months the radio show did without {Prod}", "Anything open and simple, not {Prod}", "I have no idea", "we do not miss it"]


ORDINARY_WORDS = sorted(w for w in ORDINARY if len(w) > 2)


class Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def digits(self, n: int) -> str:
        return "".join(str(self.rng.integers(10)) for _ in range(n))

    def surname(self) -> str:
        s = (self.pick(ONSETS) + self.pick(MIDDLES) + self.pick(ENDS)).replace("-", "").capitalize()
        kind = self.rng.random()
        if kind < 0.06:
            return "O'" + s
        if kind < 0.12:
            return "Mc" + s
        if kind < 0.2:
            return s + "-" + (self.pick(ONSETS) + self.pick(MIDDLES) + "nt").capitalize()
        return s

    def product(self) -> str:
        return (self.pick(ONSETS) + self.pick(MIDDLES) + self.pick("r l n v m x".split()) + self.pick(MIDDLES) + self.pick(PRODUCT_ENDS)).capitalize()

    def slip(self) -> str:
        """A product with a letter left out, doubled or at its end lost."""
        word = self.product()
        i = int(self.rng.integers(1, len(word) - 1))
        return self.pick([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:-1]])

    def first(self) -> str:
        if self.rng.random() < 0.3:  # names that no list has
            return (self.pick(ONSETS) + self.pick(MIDDLES) + self.pick(["na", "n", "ta", "no", "k", "ce", "li", "bena", "diwe", "ban", "yen", "sha", "mir", "oumi", "wen", "hoa"])).capitalize()
        return self.pick(sorted(FIRST_NAMES)).capitalize()

    def name(self) -> str:
        letter = self.pick("ABCDEFGHIJKLMNOPRSTUVWZ")
        return self.pick([lambda: f"{self.first()} {self.surname()}", lambda: f"{self.first()} {self.surname()}", lambda: f"{self.first()} {letter}. {self.surname()}", lambda: f"{letter}. {self.surname()}", lambda: f"{self.surname()}, {self.first()}", lambda: f"{self.first()} {self.first()} {self.surname()}", lambda: self.first(), lambda: f"{self.pick(TITLES)}{self.pick(['.', '.', ''])} {self.surname()}"])()

    def email(self) -> str:
        user = self.pick([f"{self.first()}.{self.surname()}", f"{self.surname()}+leads", f"{self.first()}_{self.digits(2)}", "info", "sales.desk", f"{self.first()}-{self.surname()}"]).lower().replace("'", "")
        domain = self.pick(DOMAINS)
        text = self.pick([f"{user}@{domain}", f"{user}@{domain}", f"{user}(at){domain}", f"{user} [at] {domain.replace('.', ' [dot] ')}", f"{user} at {domain.replace('.', ' dot ')}"])
        return text.upper() if self.rng.random() < 0.1 else text

    def phone(self) -> str:
        d = self.digits
        return self.pick([
            lambda: f"+44 7700 900{d(3)}", lambda: f"07700 900 {d(3)}", lambda: f"0044 1632 960 {d(3)}", lambda: f"+44 (0)1632 960{d(3)}", lambda: f"020 7946 0{d(3)}", lambda: f"01632 960 {d(3)}",
            lambda: f"({d(3)}) 555-0{d(3)}", lambda: f"{d(3)}-555-0{d(3)}", lambda: f"{d(3)}.555.0{d(3)}", lambda: f"+1 {d(3)} 555 0{d(3)}", lambda: f"1{d(3)}5550{d(3)}", lambda: f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+49 (0)30 {d(5)} {d(3)}", lambda: f"+49 30 {d(8)}", lambda: f"+34 6{d(2)} {d(3)} {d(3)}",
        ])()

    def id_number(self) -> tuple[str, str]:
        d, caps = self.digits, "ABCEGHJKLMNPRSTWXYZ"
        return self.pick([
            lambda: ("SSN ", f"9{d(2)}-{d(2)}-{d(4)}"), lambda: ("", f"9{d(2)}-{d(2)}-{d(4)}"), lambda: ("social security number ", f"000 {d(2)} {d(4)}"), lambda: ("NINO ", f"QQ{d(6)}{self.pick('ABCD')}"), lambda: ("national insurance ", f"QQ {d(2)} {d(2)} {d(2)} {self.pick('ABCD')}"),
            lambda: ("passport no. ", f"{self.pick('XZ')}{self.pick(caps)}{d(7)}"), lambda: ("passport ", f"{self.pick(caps)}{d(8)}"), lambda: ("DNI ", f"{d(8)}-{self.pick(caps)}"), lambda: ("tax id ", f"{d(2)} {d(3)} {d(3)} {d(3)}"), lambda: ("IBAN ", f"{self.pick(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}"), lambda: ("", f"{self.pick(['DE', 'FR', 'ES', 'NL'])}{d(18)}"), lambda: ("tax number ", f"{d(11)}"), lambda: ("social security number ", f"{d(3)}-{d(2)}-{d(4)}"),
        ])()

    def address(self) -> str:
        s = self.pick([self.surname().replace("'", ""), f"{self.surname()} {self.pick(['Mill', 'End', 'Ferry', 'Hill'])}", f"Old {self.surname()}"])
        town = self.pick([self.surname(), f"{self.pick(TOWN_WORDS)} {self.surname()}", f"{self.surname()} {self.pick(['Bay', 'Point', 'Falls'])}"])
        n = str(int(self.rng.integers(1, 900)))
        street = f"{n} {s} {self.pick(STREETS)}"
        if self.rng.random() < 0.05:
            return f"PO Box {n}, {town}"
        return self.pick([street, f"{street}, {town}", f"{street}.", f"Apt {self.digits(2)}B, {street}, {town} {self.digits(5)}", f"Unit {self.digits(2)}, {s} Court, {town}", f"Calle {s} {n}, {town}", f"{n} rue {s}, {town}", f"{s}weg {n}, {town}", f"{s}weg {n}a, {town}", f"{s} Str. {n}, {self.digits(5)} {town}", f"{s}straße {n}, {town}"])

    def nothing(self, pattern: str) -> str:
        values = {"ip": lambda: f"{self.rng.integers(1, 255)}.{self.rng.integers(255)}.{self.rng.integers(9)}.{self.rng.integers(255)}", "date": lambda: f"2026-0{self.rng.integers(1, 9)}-{self.rng.integers(10, 28)}", "year": lambda: "2026", "hex": lambda: "".join(self.pick("0123456789abcdef") for _ in range(12)), "round": lambda: f"{self.rng.integers(1, 9)}00-{self.rng.integers(1, 9)}00-{self.rng.integers(1, 9)}000", "AA": lambda: self.pick("QZ") + self.pick("XZ"), "Cap": lambda: self.surname().replace("'", "").replace("-", ""), "low": lambda: self.surname().lower().replace("'", "").replace("-", ""), "First": self.first, "Prod": self.product, "Month": lambda: self.pick(["June", "May", "March"])}
        out = pattern
        for key, make in values.items():
            while "{" + key + "}" in out:
                out = out.replace("{" + key + "}", str(make()), 1)
        for n in range(10, 0, -1):
            while f"{{d{n}}}" in out:
                out = out.replace(f"{{d{n}}}", self.digits(n), 1)
        return out

    def words(self, pool: list[str], least: int, most: int) -> str:
        return " ".join(self.pick(pool) for _ in range(int(self.rng.integers(least, most + 1))))

    def random_frame(self) -> str:
        """A frame of random small words, so that a name is known by itself and not by the frame."""
        german = self.rng.random() < 0.2
        pool = GERMAN_POOL if german else POOL
        before, after = self.words(pool, 0, 5), self.words(pool, 0, 5)
        if german and self.rng.random() < 0.7:
            after = f"{after} {self.pick(GERMAN_NOUNS)}".strip()
        before = before[:1].upper() + before[1:]
        return f"{before}{self.pick([' ', ' ', ' ', ', '])}{{}}{self.pick([' ', ' ', ', '])}{after}".strip(" ,") if before else f"{{}} {after}".strip()

    def random_nothing(self) -> str:
        """Small words around something with capitals that is no person."""
        ordinary = lambda: self.pick(ORDINARY_WORDS).capitalize()
        noun = lambda: self.pick(GERMAN_NOUNS)
        if self.rng.random() < 0.3:
            thing = self.pick([noun, lambda: f"{noun()} {self.pick(GERMAN_POOL)} {noun()}", lambda: f"{self.pick(['Letzten', 'Neue', 'Unser', 'Guter', 'Zum'])} {noun()}", self.product])()
            text = f"{self.words(GERMAN_POOL, 1, 4)} {thing} {self.words(GERMAN_POOL, 0, 4)}"
        else:
            thing = self.pick([self.product, lambda: f"{self.product()} {self.product()}", lambda: f"{ordinary()} {ordinary()}", ordinary, lambda: f"{ordinary()} {ordinary()} {ordinary()}", lambda: f"{self.product()} {ordinary()}", lambda: ordinary().upper(), lambda: f"{self.first()} {ordinary()}", lambda: self.pick(POOL).capitalize(), lambda: self.words(POOL, 1, 3).upper(), self.slip])()
            text = f"{self.words(POOL, 0, 5)} {thing} {self.words(POOL, 0, 5)}".strip()
        return text[:1].upper() + text[1:]

    def item(self, kind: str) -> tuple[str, list[tuple[int, int]]]:
        """A phrase with one item and its span."""
        lead, text = self.id_number() if kind == "id_number" else ("", getattr(self, kind)())
        frame = self.random_frame() if kind == "name" and self.rng.random() < 0.4 else self.pick(BEFORE[kind])
        start = frame.index("{}") + len(lead)
        return frame.replace("{}", lead + text), (start, start + len(text))


def training_sentences(rng: np.random.Generator, n: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    make = Maker(rng)
    kinds = list(BEFORE)
    for _ in range(n):
        if rng.random() < 0.45:
            text = make.random_nothing() if rng.random() < 0.35 else make.nothing(make.pick(NOTHING))
            if rng.random() < 0.3:
                text += make.pick([". ", " ", ", "]) + make.nothing(make.pick([*NOTHING, *FILLERS]))
            yield text + make.pick([".", "!", ""]), []
            continue
        kind = make.pick(kinds)
        text, (a, b) = make.item(kind)
        spans = [(a, b, kind)]
        if rng.random() < 0.35:
            other = make.pick(kinds)
            more, (a2, b2) = make.item(other)
            bare = more[a2:b2]
            joint = make.pick(["; also ", ", or ", " / ", "! "])
            start = len(text) + len(joint)
            text, spans = text + joint + bare, [*spans, (start, start + len(bare), other)]
        if rng.random() < 0.25:
            text += make.pick([" ", ". ", "! "]) + make.nothing(make.pick([*NOTHING, *FILLERS]))
        elif rng.random() < 0.25:
            lead = make.nothing(make.pick([*NOTHING, *FILLERS])) + make.pick([" ", ". ", "! "])
            text, spans = lead + text, [(a + len(lead), b + len(lead), k) for a, b, k in spans]
        yield text + make.pick([".", "!", ""]), spans
