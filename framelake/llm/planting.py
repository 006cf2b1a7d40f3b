"""Labelled rows made by planting: invented persons' data, and look-alikes, put into real documents.

A corpus has no labelled rows of its own, so sentences with known cases are put between those of
real documents, and cases and look-alikes into real sentences, between any two plain words. Every
candidate span there is labelled by construction, 1 if it is a planted case from end to end and 0
otherwise; nothing that the trees see takes part in that. Candidates elsewhere stay unlabelled. The
held-out sentences are other ones than those trained on, and their documents are others too.
"""

from __future__ import annotations

import random
import re
from collections.abc import Container, Sequence
from dataclasses import dataclass, field

from framelake.llm.words import Register

# Sentences in English, French and German; a field in braces is planted. {name} to {id} are
# cases, the others are not: {member}, {place}, {thing} with a number behind it, {amount}, {date}.
TRAIN = {
    "en": [
        "I have here a letter from {title} {name} of {address}, who asked for help.", "{name} wrote to me; the answer should go to {email}.", "Please call {phone} and ask for {name}.", "Her passport {id} was lost near {place}.",
        "On the form stood tax number {id}, and then {phone} or {email}.", "The late {title} {name} knew it, and so did {member}.", "The list gives {lastfirst} as the owner.", "{title} {last} was not heard.", "He lives at {address}, as everyone in {place} knows.",
        "{thing} {number} was never answered.", "It would cost {amount} crowns by {date}.", "The {place} {body} was told on {date}, and {place} {body} again.", "We thank {title} {member} for {thing} {number}.", "See {thing} {reference}, page {small}.", "Write to {email} / {phone}.",
        "The card with identity number {id} belongs to {name}.", "{thing} {number}, {thing} {reference} and the {body} of {place} are not in the report.", "The insurance number was {id}.", "It opened at {time} and shut at {time}, not at {time}.", "It read: {id}.", "It was at {address}, in the rain, that {name} fell.", "The letter is from {address}, without a stamp.", "There stood {phone}, or was it {phone}.", "He gave the number {phone} to {title} {lastfirst}.", "It took {small} {common} {street}, then {small} {common} {common} {street} more.", "{common} {name} and {common} {last} were there.", "{member} and {name} met on the way.", "A note says: {address}; {phone}.",
    ],
    "fr": [
        "J'ai reçu une lettre de {title} {name}, {address}, qui attend encore.", "{name} m'écrit depuis {email}.", "On peut joindre {name} au {phone}.", "Son passeport porte le numéro {id}.", "Le dossier donne {lastfirst} et le {phone}.", "{title} {last} n'a pas été entendue.",
        "{thing} {number} reste sans réponse.", "Il en coûterait {amount} couronnes avant le {date}.", "La {body} de {place} l'a su le {date}.", "Je remercie {title} {member} pour {thing} {reference}.", "Numéro de sécurité sociale {id}, domicilié {address}.", "Répondre à {email} ou au {phone}.",
        "Ni {member} ni {name} n'ont lu {thing} {number}.", "La carte {id} appartient à {title} {name}.", "On lisait : {id}.", "C'était au {address}, sans lumière.", "Le téléphone est le {phone}, je crois.", "C'était à {time}, non à {time}.", "Le numéro {phone} est celui de {title} {lastfirst}.",
    ],
    "de": [
        "Mir liegt ein Brief von {title} {name} vor, wohnhaft {address}.", "{name} schreibt mir von {email}.", "Man erreicht {name} unter {phone}.", "Der Reisepass {id} ging in {place} verloren.", "In der Akte steht {lastfirst}, Telefon {phone}.", "{title} {last} wurde nicht gehört.",
        "{thing} {number} blieb ohne Antwort.", "Das kostet {amount} Kronen bis zum {date}.", "Das {body} in {place} wusste es am {date}.", "Ich danke {title} {member} für {thing} {reference}.", "Steuernummer {id}, Anschrift {address}.", "Antwort an {email} oder {phone}.",
        "Weder {member} noch {name} kennen {thing} {number}.", "Die Versicherungsnummer {id} gehört {title} {name}.", "Es hieß: {id}.", "Es war in der {address}, ohne Licht.", "Der Apparat ist {phone}, glaube ich.", "Es war um {time}, nicht um {time}.", "Die Nummer {phone} hat {title} {lastfirst}.",
    ],
}
HELD_OUT = {
    "en": [
        "A nurse, {name}, left {phone} and {email} with the clerk.", "{title} {name} moved to {address} last spring.", "The clinic had written down personal number {id} for her.", "They read out {lastfirst} and then {thing} {number}.", "Nobody at the {place} {body} told {name}; {member} did.",
        "Between {date} and {date} it rose to {amount} crowns.", "{title} {last} rang from {phone}.", "Nothing in {thing} {reference} concerns {place}.",
    ],
    "fr": ["Une infirmière, {name}, a laissé le {phone} et {email}.", "{title} {name} a déménagé au {address}.", "La clinique avait noté la carte {id}.", "On a lu {lastfirst}, puis {thing} {number}.", "{title} {last} a appelé depuis le {phone}.", "Entre le {date} et le {date}, {amount} couronnes."],
    "de": ["Eine Pflegerin, {name}, hinterließ {phone} und {email}.", "{title} {name} zog in die {address}.", "Die Klinik notierte den Ausweis {id}.", "Verlesen wurde {lastfirst}, danach {thing} {number}.", "{title} {last} rief von {phone} an.", "Vom {date} bis zum {date} waren es {amount} Kronen."],
}
PIECES = [
    "{name}", "{name}", "{name}", "{title} {name}", "{title} {name}", "{title} {last}", "{title} {last}", "{title} {lastfirst}", "{lastfirst}", "{member}", "{title} {member}", "{email}", "{email}", "{phone}", "{phone}", "{id}", "{id}", "{address}", "{address}",
    "{thing} {number}", "{thing} {number}", "{thing} {reference}", "{amount}", "{number}/{small}", "{date}", "at {time}", "{small} {common} {street}",
]
TITLES = {"en": ["Mr", "Mrs", "Ms", "Dr", "Mr."], "fr": ["M.", "Mme", "Mlle", "Monsieur", "Madame"], "de": ["Herr", "Frau", "Frau Dr.", "Herrn"]}
BODIES = {"en": ["Infirmary", "Hall", "School", "Council", "Bridge", "Mill", "Road", "Committee"], "fr": ["mairie", "commission", "gare", "école"], "de": ["Amt", "Werk", "Rathaus", "Ministerium"]}
STREETS = {"en": ["Road", "Rd", "St", "Lane", "Close", "Quay", "Street", "Avenue", "Terrace", "Square", "Drive", "Court"], "fr": ["rue", "avenue", "chemin", "impasse", "place", "quai", "allée", "boulevard"], "de": ["straße", "str.", "weg", "gasse", "allee", "platz", "ufer"]}
_FIELD = re.compile(r"\{(\w+)\}")
CASES = {"name": "name", "member": "member", "lastfirst": "name", "last": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address"}


@dataclass
class Pools:
    """What planted data are made of: names of members to share parts with, words that numbers follow in the corpus, and common words."""

    members: Sequence[tuple[str, str]]
    things: list[str]
    common: list[str]
    taken: Container[tuple[str, str]] = field(default=frozenset())
    syllables: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.taken = self.members if isinstance(self.members, Register) else frozenset((f.lower(), l.lower()) for f, l in self.members)
        parts = sorted({n.lower()[i : i + 3] for f, l in self.members for n in (f, l) for k in (2, 3, 4) for i in range(0, max(1, len(n) - k + 1), 2) if n[i : i + k].isalpha()})
        self.syllables = parts if len(parts) >= 8 else ["ba", "dor", "kel", "mi", "nu", "ras", "tov", "zel", "ilk", "ona"]

    def word(self, rng: random.Random) -> str:
        return "".join(rng.choice(self.syllables) for _ in range(rng.choice((1, 2, 2, 3)))).capitalize()

    def first(self, rng: random.Random) -> str:
        if self.members and rng.random() < 0.5:
            return rng.choice(self.members)[0].capitalize()
        return f"{self.word(rng)}-{self.word(rng)}" if rng.random() < 0.1 else self.word(rng)

    def last(self, rng: random.Random) -> str:
        how = rng.random()
        if self.members and how < 0.15:
            return rng.choice(self.members)[1].capitalize()
        if self.common and how < 0.2:
            return rng.choice(self.common).capitalize()  # a common word that is a name as well
        w = self.word(rng)
        return rng.choice([f"van {w}", f"van {w}", f"von {w}", f"O'{w}", f"{w}-{self.word(rng)}"]) if rng.random() < 0.25 else w

    def person(self, rng: random.Random) -> tuple[str, str]:
        while True:
            f, l = self.first(rng), self.last(rng)
            if (f.lower(), l.lower()) not in self.taken and f.lower() != l.lower():
                return f, l


def digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _grouped(rng: random.Random, sizes: list[int], by: str = " ") -> str:
    return by.join(digits(rng, n) for n in sizes)


def _phone(rng: random.Random) -> str:
    head = rng.choice(["0", "0", "(0)", "+", "00"])
    by = rng.choice([" ", " ", "-", ".", "/", ""])
    if head == "+" or head == "00":
        core = f"{head}{digits(rng, rng.choice((2, 3)))} {rng.choice(['', '(0)'])}{_grouped(rng, rng.choice([[2, 6], [3, 3, 3], [2, 3, 4]]), by or ' ')}"
    elif rng.random() < 0.25:
        core = f"0{digits(rng, 1)}{by}{_grouped(rng, [2, 2, 2, 2], by)}"
    else:
        core = f"{'(0' + digits(rng, 3) + ')' if head == '(0)' else '0' + digits(rng, 3)}{by or ' '}{_grouped(rng, rng.choice([[6], [3, 3], [2, 2, 2], [4, 2]]), by)}"
    if rng.random() < 0.1:
        core = f"{digits(rng, 3)}-{digits(rng, 4)}"
    elif rng.random() < 0.15:
        core = f"0{digits(rng, 3)}/{digits(rng, rng.choice((3, 4)))}-{digits(rng, rng.choice((1, 2, 3)))}"
    return core + (f"{rng.choice([' ext. ', ' x', ' poste ', ', app. '])}{digits(rng, 3)}" if rng.random() < 0.15 else "")


_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"


def _id(rng: random.Random) -> str:
    a, b, c = (rng.choice(_LETTERS) for _ in range(3))
    return rng.choice(
        [f"{a}{digits(rng, 7)}", f"{a}{b}{digits(rng, 6)}{c}", f"{a}{b} {_grouped(rng, [2, 2, 2])} {c}", f"{digits(rng, 6)}-{digits(rng, 4)}", digits(rng, 11), _grouped(rng, [2, 3, 3, 3]), _grouped(rng, [4, 4, 4, 4])]
    )


def _number(rng: random.Random) -> str:
    """Of a thing: forms that persons' numbers have too, and others."""
    return rng.choice([digits(rng, 11), _grouped(rng, [2, 3, 3, 3]), _grouped(rng, [4, 4, 4, 4]), digits(rng, rng.randint(6, 9)), f"{digits(rng, 4)}/20{digits(rng, 2)}", f"0{digits(rng, 3)}/{digits(rng, 2)}-{digits(rng, 1)}"])


def _email(rng: random.Random, pools: Pools) -> str:
    local = rng.choice([pools.word(rng), f"{pools.word(rng)}.{pools.word(rng)}", f"{pools.word(rng)}_{digits(rng, 2)}", f"{pools.word(rng)[:1]}.{pools.word(rng)}", f"{pools.word(rng)}+{pools.word(rng)}"]).lower()
    host = rng.choice(["{}.test", "{}.example", "my.{}.example", "{}.invalid", "post-{}.test"]).format(pools.word(rng).lower())
    how = rng.random()
    if how < 0.5:
        out = f"{local}@{host}"
        return out.upper() if rng.random() < 0.1 else out
    if how < 0.7:
        at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", ".")])
        return local.replace(".", dot) + at + host.replace(".", dot)
    dot = rng.choice([" dot ", " point ", " punkt "])
    at = {" dot ": " at ", " point ": " arobase ", " punkt ": " ät "}[dot]
    return local.replace(".", dot) + at + host.replace(".", dot)


def _address(rng: random.Random, lang: str, pools: Pools) -> str:
    no = f"{rng.randint(1, 220)}{rng.choice(['', '', '', 'a', 'b'])}"
    flat = f"{rng.choice({'en': ['Flat', 'Apt'], 'fr': ['appt'], 'de': ['Wohnung']}[lang])} {rng.randint(1, 30)}, " if rng.random() < 0.1 else ""
    street, town, code = pools.word(rng), pools.word(rng), digits(rng, 4)
    kind = rng.choice(STREETS[lang])
    if lang == "en":
        return f"{flat}{no}{rng.choice([' ', ', '])}{street} {kind}" + rng.choice(["", f", {town}", f", {town} {code}"])
    if lang == "fr":
        return f"{flat}{no}{rng.choice(['', ' bis'])}, {kind} {rng.choice(['', 'de ', 'du '])}{street}" + rng.choice(["", f", {code} {town}", f", {town}"])
    return f"{flat}{street}{kind} {no}" + rng.choice([f", {code} {town}", f" in {town}", ""])


def _member(rng: random.Random, pools: Pools) -> str:
    return " ".join(n.capitalize() for n in rng.choice(pools.members)) if pools.members else pools.word(rng)


def sentence(rng: random.Random, lang: str, templates: dict[str, list[str]], pools: Pools) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence and its cases (kind, start, end); a member's name has the kind ``member``."""
    template = rng.choice(templates[lang])
    who = pools.person(rng)
    return filled(template, rng, lang, pools, who)


def filled(template: str, rng: random.Random, lang: str, pools: Pools, who: tuple[str, str]) -> tuple[str, list[tuple[str, int, int]]]:
    out, cases, end = "", [], 0
    for m in _FIELD.finditer(template):
        out += template[end : m.start()]
        end = m.end()
        what = m.group(1)
        if what == "name":
            initials = f"{who[0][0]}." if rng.random() < 0.7 else f"{who[0][0]}. {rng.choice(_LETTERS)}."
            middle = rng.choice(["", "", "", "", f"{rng.choice(_LETTERS)}. ", f"{pools.first(rng)} ", f"{pools.first(rng)} "])
            text = f"{initials} {who[1]}" if rng.random() < 0.12 else f"{who[0]} {middle}{who[1].upper() if rng.random() < 0.08 else who[1]}"
        elif what == "lastfirst":
            text = f"{who[1]}, {who[0]}"
        elif what == "last":
            text = rng.choice(pools.common).capitalize() if pools.common and rng.random() < 0.1 else f"{rng.choice(['', '', '', '', 'van '])}{pools.word(rng)}"  # not a member's, as the register would read it
        else:
            text = {
                "email": lambda: _email(rng, pools), "phone": lambda: _phone(rng), "id": lambda: _id(rng), "address": lambda: _address(rng, lang, pools), "title": lambda: rng.choice(TITLES[lang]),
                "member": lambda: _member(rng, pools), "place": lambda: pools.word(rng), "body": lambda: rng.choice(BODIES[lang]), "street": lambda: rng.choice(STREETS["en"]).lower(), "thing": lambda: rng.choice(pools.things or ["file"]), "common": lambda: rng.choice(pools.common or ["long"]),
                "number": lambda: _number(rng), "reference": lambda: f"{digits(rng, 4)}/{digits(rng, 2)}", "amount": lambda: _grouped(rng, [rng.randint(1, 3), 3, 3], rng.choice([" ", ",", "."])), "small": lambda: str(rng.randint(2, 90)), "time": lambda: f"{rng.randint(1, 23)}{rng.choice('.:')}{rng.randint(10, 59)}",
                "date": lambda: rng.choice([f"{rng.randint(10, 28)}.0{rng.randint(1, 9)}.20{digits(rng, 2)}", f"20{digits(rng, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/20{digits(rng, 2)}"]),
            }[what]()
        if what in CASES:
            cases.append((CASES[what], len(out), len(out) + len(text)))
        out += text
    return out + template[end:], cases


_BREAK = re.compile(r"(?<=[.!?]) ")
_FR, _DE = re.compile(r"\b(?:le|la|les|des|est|une)\b", re.I), re.compile(r"\b(?:der|die|das|und|ist|ein)\b", re.I)


def language(text: str) -> str:
    head = text[:2000]
    fr, de = len(_FR.findall(head)), len(_DE.findall(head))
    return "fr" if fr > 3 and fr > de else "de" if de > 3 else "en"


_GAP = re.compile(r"(?<=[^\W\d_A-Z]{3}) (?=[^\W\d_A-Z]{3})")


def planted(text: str, rng: random.Random, templates: dict[str, list[str]], pools: Pools, n: int = 4, pieces: bool = True) -> tuple[str, list[tuple[int, int]], list[tuple[str, int, int]]]:
    """(text, planted stretches, cases): up to ``n`` sentences put between those of a document, and as many pieces into its sentences."""
    lang = language(text)
    lower = text == text.lower()
    between = [m.start() for m in _BREAK.finditer(text)] or [len(text)]
    within = [m.start() for m in _GAP.finditer(text)] if pieces else []
    places = [(at, False) for at in rng.sample(between, min(n, len(between)))] + [(at, True) for at in rng.sample(within, min(n, len(within)))]
    out, stretches, cases, last = "", [], [], 0
    for at, piece in sorted(places):
        made, own = filled(rng.choice(PIECES), rng, lang, pools, pools.person(rng)) if piece else sentence(rng, lang, templates, pools)
        made = made.lower() if lower else made
        out += text[last:at] + " "
        cases += [(k, len(out) + s, len(out) + e) for k, s, e in own]
        stretches.append((len(out), len(out) + len(made)))
        out += made
        last = at
    return out + text[last:], stretches, cases
