"""Reading names of institutions, organisations and firms as people type them.

A typed name is repaired (double-encoded UTF-8, entities, digits for letters), folded (case, accents), cut into segments at
commas, dashes and brackets, and its words are matched to a vocabulary of generic words with their abbreviations and foreign
forms, small typing errors allowed. Segments that only name a faculty, board, office, degree or legal form are set aside.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from rollbook.llm.automaton import WordTrie

# Generic words of body names with their abbreviations and foreign forms.
GENERIC: dict[str, str] = {
    "university": "univ uni u univers universitat universita universidad universidade universite universiteit universitet universitetet uniwersytet univerzita egyetem",
    "technical": "tech techn technische technischen technological technology politecnica politecnico polytechnique technika",
    "catholic": "cath catholique katholische cattolica catolica",
    "medical": "med medizinische medicale",
    "school": "sch schl",
    "economics": "econ economic economy",
    "business": "bus",
    "administration": "admin adm",
    "national": "nat natl nationale",
    "college": "coll col",
    "european": "eur europ europe",
    "studies": "stud",
    "institute": "inst institut",
    "transatlantic": "transatl",
    "foundation": "fdn found fndn",
    "association": "assoc assn ass",
    "renewal": "",
    "policy": "pol",
    "society": "soc",
    "council": "cncl",
    "dialogue": "dialog",
    "centre": "ctr center cent",
    "foreign": "",
    "relations": "rel rels",
    "security": "sec",
    "forum": "",
    "leadership": "ldrshp leadrshp",
    "network": "netw ntwk",
    "conference": "conf",
    "round": "",
    "table": "tbl",
    "club": "",
    "friends": "",
    "lycee": "",
    "gymnasium": "gymn gym",
    "polytechnic": "polytech poly",
    "conservatory": "conserv",
    "music": "",
    "journalism": "",
    "agricultural": "agric agri",
    "naval": "",
    "academy": "acad",
    "seminary": "",
    "holding": "hldg holdings",
    "capital": "cap",
    "media": "",
    "energy": "",
    "logistics": "log",
    "advisers": "advisors adv advs",
    "legal": "leg",
    "public": "publ pub",
    "affairs": "aff",
    "partners": "partn",
    "consulting": "consult",
    "war": "",
    "fine": "",
    "arts": "",
    "law": "",
    "alma": "",
    "mater": "",
}
# Words without weight, words of parts of a body, degrees, legal forms.
STOP = frozenset("the of for in on at and de di du des der la le el et und zu do da dos van von".split())
PART = {"faculty": "fac facul", "department": "dept dep", "board": "", "office": "", "trustees": "", "advisory": "", "brussels": "bxl", "governors": "", "institute": "inst", "graduate": "grad", "school": "sch", "law": "", "economics": "econ", "energy": "", "medicine": "", "arts": "", "science": "", "engineering": "", "letters": "", "philosophy": "", "history": ""}
PART_HEADS = frozenset("faculty department board office trustees".split())
DEGREES = frozenset("phd msc mba ba ma bsc llm llb lld doctorate diploma degree bachelor master masters dr hons mphil dphil".split())
LEGAL_FORMS = frozenset("asbl ev gmbh ag spa sa bv oy ltd llp plc inc ab as nv sarl srl kg kft sro".split())
_MOJIBAKE = re.compile("[\u00c2-\u00f4](?:[\u0080-\u00bf]|[ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™])+")
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "Ø": "o", "Ł": "l", "Đ": "d"})
_DIGITS = str.maketrans("0135", "oles")
_DOTTED = re.compile(r"\b((?:[A-Za-z]\.){2,})")
_WORD = re.compile(r"[a-z0-9]+")
_YEAR = re.compile(r"(?:19|20)\d\d$")
_SEGMENT = re.compile(r"\s[–—-]\s|[,;()\[\]–—]|\s-$")


def repair(text: str) -> str:
    """Undo double encoding and character entities."""
    if "&" in text:
        text = html.unescape(text)
    return _MOJIBAKE.sub(_redecoded, text)


def _redecoded(match: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return match[0].encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return match[0]


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


_ALIASES = {a: w for w, forms in GENERIC.items() for a in [w, *forms.split()]}
_PART_ALIASES = {a: w for w, forms in PART.items() for a in [w, *forms.split()]}
# Short abbreviations are matched as they are, longer words with errors too.
_GENERIC_TRIE = WordTrie(a for a, w in _ALIASES.items() if a == w or len(a) > 4)
_PART_TRIE = WordTrie(a for a, w in _PART_ALIASES.items() if a == w or len(a) > 4)


def allowance(word: str) -> int:
    """Typing errors allowed in a word: more in longer ones."""
    n = len(word)
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 11 else 3


@lru_cache(maxsize=50_000)
def generic(word: str) -> str | None:
    """The generic word that a folded word stands for, or None."""
    return _lookup(word, _ALIASES, _GENERIC_TRIE)


@lru_cache(maxsize=50_000)
def part_word(word: str) -> str | None:
    return _lookup(word, _PART_ALIASES, _PART_TRIE)


def _lookup(word: str, aliases: dict[str, str], trie: WordTrie) -> str | None:
    if word in aliases:
        return aliases[word]
    n = len(word)
    if n < 4:
        return None
    hits = [(d, len(w), w) for w, d in trie.search(word, 1 if n < 5 else 2 if n < 11 else 3) if len(w) >= 4 and d <= (0 if len(w) < 4 else 1 if len(w) < 6 else 2 if len(w) < 11 else 3)]
    return aliases[min(hits)[2]] if hits else None


@dataclass(frozen=True)
class Typed:
    """A typed name: its main words in order, folded and OCR-repaired, and the bare word if it is a single one."""

    words: tuple[str, ...]
    aside: tuple[str, ...] = field(default=())


def _words(segment: str) -> list[str]:
    out = []
    for w in _WORD.findall(segment):
        if w.isdigit():
            out.append(w)
        else:
            out.append(w.translate(_DIGITS) if any(c.isdigit() for c in w) else w)
    return out


def _is_aside(words: list[str]) -> bool:
    """Whether a segment names only a part of a body, a degree or a legal form."""
    if not words:
        return True
    if all(w in DEGREES or w in LEGAL_FORMS for w in words):
        return True
    parts = [part_word(w) for w in words if w not in STOP]
    if not parts or any(p is None for p in parts):
        return False
    return bool(PART_HEADS & set(parts)) or parts in (["law"], ["law", "school"], ["school", "law"], ["institute", "law"], ["law", "institute"])


@lru_cache(maxsize=20_000)
def read_name(text: str) -> Typed:
    """Main words of a typed name; empty when nothing but asides, placeholders or ids is left."""
    text = repair(text)
    text = _DOTTED.sub(lambda m: m[1].replace(".", ""), text)
    folded = fold(text).replace("'", "").replace("’", "")
    folded = re.sub(r"\s+", " ", folded).strip()
    if re.fullmatch(r"q\d+", folded):
        return Typed(())
    folded = re.sub(r"\bb[- ]school\b", "business school", folded)
    folded = re.sub(r"\bb[- ]s(ch)?\.", "business school ", folded)
    main: list[str] = []
    aside: list[str] = []
    for segment in _SEGMENT.split(folded):
        words = _words(segment.replace("&", " and "))
        if _is_aside(words):
            aside += words
        else:
            main += words
    while main and main[-1] in LEGAL_FORMS and len(main) > 1:
        aside.append(main.pop())
    named = any(not w.isdigit() for w in main)  # years beside a name are when, not what
    kept = [w for i, w in enumerate(main) if w not in STOP and not (named and _YEAR.match(w)) and not (w == "f" and _for(main[i + 1 :]))]
    return Typed(tuple(kept), tuple(aside))


def _for(rest: list[str]) -> bool:
    """Whether an "f" before these words stands for "for"."""
    return bool(rest) and generic(rest[0]) in ("european", "foreign", "transatlantic")
