"""Mapping free-entered values to a reference list.

Every entry of the list becomes paths of words in a trie: its canonical, short and local names, their rotations (place first,
type first), the name without its town, colloquial forms, given aliases, and its acronym. The words of a typed value walk the
trie; each step goes to all words within a length-dependent Levenshtein distance, found by an automaton over the characters of
the trie's words; two typed words may stand for one. `reference_hits` gives all entries reached at the end of the value with
their distances, `nearest_reference` the nearest one; ties go to the smallest ref_id and can be seen in the hits.

Acronyms: an entry's short name; for an entry without one, what the rules make of its name that make many of the list's short
names of theirs (`acronym_rules`), if no other entry has it. That is judged over the whole list, before any block is cut.

Equal values are looked up once. A list of at most `max_entries` is held by every task. A longer one is cut into blocks; each
value passes the automaton of every block, and the nearest entry is an aggregate over all. The rows do not depend on the way.

Cases: null and empty values, placeholders, degrees, bare ids and values that no entry explains whole get ref_id 0 and a null
distance; an empty reference list gives 0 everywhere; columns of df named like the results are replaced, all others kept; a
result does not depend on repeated or neighbouring rows; entries with equal short names are both among the hits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.automaton import WordTrie
from rollbook.llm.names import DEGREES, fold, generic, read_name
from rollbook.session import cut, fresh, spread

#: Entries per trie; a longer list is searched block by block.
MAX_ENTRIES = 50_000
#: Values that one task takes through a block; the block is repeated for more.
VALUES_PER_BLOCK = 200_000
#: Share of the list's short names that a rule must make to be used for entries without one, and letters of a made acronym.
RULE_SHARE, LEAST_LETTERS = 0.2, 4
_VOWELS = frozenset("aeiouy")

# Colloquial forms of names that are a kind of body and a town ("*"), by the sorted generic words of the name.
COLLOQUIAL = {
    "university": ("alma mater *",),
    "technical university": ("technical *", "tu *"),
    "economics school": ("economics *",),
    "administration national school": ("administration school *", "school administration *"),
    "catholic university": ("cu *",),
}


@dataclass(frozen=True)
class Entry:
    """An entry of the list; acronyms: those that denote it, None if they are still to be told from the whole list."""

    ref_id: int
    kind: str
    canonical: str
    short: str | None
    local: str | None
    city: str | None
    aliases: tuple[str, ...] = ()
    acronyms: tuple[str, ...] | None = None


def reach(n: int) -> int:
    """Levenshtein distance allowed to a word of n letters of the list; wide, as all words of a value must fit one path."""
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 7 else 3


def plain_words(text: str) -> list[str]:
    return list(read_name(text).words)


def _starts(word: str) -> Iterator[tuple[str, str]]:
    """(rule, letters) that can stand for a word in an acronym: its first letters or first consonants."""
    letters = "".join(c for c in word if c.isalpha())
    consonants = "".join(c for c in letters if c not in _VOWELS)
    for n in range(1, 6):
        yield f"letters {n}", letters[:n]
        yield f"consonants {n}", consonants[:n]


def formed_acronyms(e: Entry) -> dict[str, str]:
    """rule -> acronym: initials of the words in the order of the name, the rule's letters for the town."""
    words, place = plain_words(e.canonical), plain_words(e.city) if e.city else []
    if not any(w in place for w in words):
        return {}
    out = {}
    for rule, town in _starts("".join(place)):
        made, done = "", False
        for w in words:
            if w not in place:
                made += w[0]
            elif not done:
                made, done = made + town, True
        out[rule] = made
    return out


def rule_votes(e: Entry) -> list[str]:
    """Rules that make the entry's short name; '' for every entry with a short name and a town."""
    made = formed_acronyms(e) if e.short else {}
    return ["", *(r for r, a in made.items() if a == fold(e.short))] if made else []


def acronym_rules(votes: Counter[str]) -> list[str]:
    return sorted(r for r, n in votes.items() if r and n >= RULE_SHARE * votes[""])


def proposed(e: Entry, rules: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """(acronym, whether it is the short name) of an entry."""
    if e.short:
        yield fold(e.short), True
    elif e.kind == "institution":
        made = formed_acronyms(e)
        yield from {(made[r], False) for r in rules if r in made and len(made[r]) >= LEAST_LETTERS}


def told_apart(entries: Sequence[Entry]) -> list[Entry]:
    """The entries of a whole list with the acronyms that denote them: short names, else made ones that no other entry has."""
    rules = acronym_rules(Counter(r for e in entries for r in rule_votes(e)))
    given: dict[str, bool] = {}
    made: Counter[str] = Counter()
    own = [list(proposed(e, rules)) for e in entries]
    for pairs in own:
        for a, short in pairs:
            given[a] = given.get(a, False) or short
            made[a] += not short
    return [replace(e, acronyms=tuple(a for a, short in pairs if short or not given[a] and made[a] == 1)) for e, pairs in zip(entries, own)]


def alias_paths(e: Entry) -> Iterator[tuple[str, ...]]:
    """Word paths under which the entry is known."""
    words = plain_words(e.canonical)
    place = plain_words(e.city) if e.city else []
    seen = set()

    def rotations(ws: list[str]) -> Iterator[tuple[str, ...]]:
        for i in range(len(ws)):
            path = tuple(ws[i:] + ws[:i])
            if path and path not in seen:
                seen.add(path)
                yield path

    for name in (e.canonical, e.local, *e.aliases):
        if name:
            yield from rotations(plain_words(name))
    kinds = [generic(w) or "" for w in words]
    named = [w for w, k in zip(words, kinds) if not k and w not in place]
    at_place = bool(place) and all(p in words for p in place)
    if named and at_place:
        rest = [w for w in words if w not in place]
        if any(generic(w) for w in rest):
            yield from rotations(rest)
    if at_place and not named:
        for form in COLLOQUIAL.get(" ".join(sorted(k for k in kinds if k)), ()):
            yield from rotations([x for w in form.split() for x in (place if w == "*" else [w])])


#: (stage, distance, ref_id, acronym): how a value was read, nearer readings first; the acronym where one was corrected.
Hit = tuple[int, int, int, str]
WHOLE, WITHOUT_DEGREE, SPLIT, WITHOUT_ACRONYM, ACRONYM, NEAR_ACRONYM = range(6)


class ReferenceIndex:
    """Word trie of the alias paths and character trie of their words."""

    def __init__(self, entries: Sequence[Entry]) -> None:
        self.paths: dict = {}
        words: set[str] = set()
        self.generics: dict[str, set[str]] = {}
        self.acronyms: dict[str, set[int]] = {}
        if any(e.acronyms is None for e in entries):
            entries = told_apart(entries)
        for e in entries:
            for path in alias_paths(e):
                node = self.paths
                for w in path:
                    words.add(w)
                    node = node.setdefault(w, {})
                node.setdefault("", set()).add(e.ref_id)
            for a in e.acronyms or ():
                self.acronyms.setdefault(a, set()).add(e.ref_id)
        self.words = WordTrie(words)
        self.acronym_trie = WordTrie(self.acronyms)
        for w in words:
            if g := generic(w):
                self.generics.setdefault(g, set()).add(w)
        self.near: dict[str, list[tuple[str, int]]] = {}
        self.near_joined: dict[str, list[tuple[str, int]]] = {}

    def candidates(self, word: str) -> list[tuple[str, int]]:
        """Words of the paths within the distance allowed for the word, with their distances; generic words by meaning."""
        if (known := self.near.get(word)) is None:
            found: dict[str, int] = {}
            if g := generic(word):
                found |= dict.fromkeys(self.generics.get(g, ()), 0)
            for w, d in self.words.search(word, reach(len(word) + 2) if len(word) > 3 else 0, reach):
                if w not in found or d < found[w]:
                    found[w] = d
            known = self.near[word] = sorted(found.items(), key=lambda x: x[1])
            if len(self.near) > 100_000:
                self.near.clear()
        return known

    def joined(self, word: str) -> list[tuple[str, int]]:
        """Words of the paths that two typed words, written together, can stand for."""
        if (known := self.near_joined.get(word)) is None:
            if len(self.near_joined) > 100_000:
                self.near_joined.clear()
            known = self.near_joined[word] = self.words.search(word, 1)
        return known

    def matches(self, words: Sequence[str], split: bool = False) -> dict[int, int]:
        """ref_id -> total distance of every entry with a path matching all the words; split: a word may be typed as two."""
        found: dict[int, int] = {}
        budget = 2 + len(words)
        stack = [(self.paths, 0, 0)]
        while stack:
            node, i, cost = stack.pop()
            if i == len(words):
                for ref in node.get("", ()):
                    if cost < found.get(ref, 99):
                        found[ref] = cost
                continue
            for w, d in self.candidates(words[i]):
                if cost + d <= budget and w in node:
                    stack.append((node[w], i + 1, cost + d))
            if split and i + 1 < len(words) and len(words[i]) + len(words[i + 1]) > 5:
                for w, d in self.joined(words[i] + words[i + 1]):
                    if cost + d < budget and w in node:
                        stack.append((node[w], i + 2, cost + d + 1))
        return found

    def hits(self, text: str | None) -> list[Hit]:
        """All entries that the value can denote in the first way of reading it that finds any."""
        words = read_name(text).words if text else ()
        if not words:
            return []
        content = tuple(w for w in words if w not in DEGREES)
        fewer = content if len(content) < len(words) else ()
        for stage, ws, split in ((WHOLE, words, False), (WITHOUT_DEGREE, fewer, False), (SPLIT, words, True)):
            if ws and (found := self.matches(ws, split)):
                return sorted((stage, d, ref, "") for ref, d in found.items())
        if len(words) > 2 and (own := self.acronyms.get(words[-1])):
            if found := [(WITHOUT_ACRONYM, d, ref, "") for ref, d in self.matches(words[:-1]).items() if ref in own]:
                return sorted(found)
        if len(words) > 1:
            return []
        if own := self.acronyms.get(words[0]):
            return sorted((ACRONYM, 0, ref, "") for ref in own)
        near = self.acronym_trie.search(words[0], 1) if len(words[0]) >= 5 else []
        return sorted((NEAR_ACRONYM, 1, ref, a) for a, _ in near for ref in self.acronyms[a])

    def lookup(self, text: str) -> tuple[int, int]:
        """(ref_id, distance) of the nearest entry, (0, 0) if none."""
        hits = self.hits(text)
        if not hits or hits[0][0] == NEAR_ACRONYM and len({a for _, _, _, a in hits}) > 1:
            return 0, 0
        return hits[0][2], hits[0][1]


_COLUMNS = ["ref_id", "kind", "canonical_name", "short_name", "local_name", "city"]
_TYPES = "ref_id int, kind string, canonical_name string, short_name string, local_name string, city string, aliases array<string>"
_HITS = "array<struct<stage:int,distance:int,ref_id:int,acronym:string>>"


def _entry(row: Sequence) -> Entry:
    r = list(row)
    given = [None if x is None or x is pd.NA or x != x else x for x in r[1:6]]
    return Entry(int(r[0]), *given, tuple(r[6] if r[6] is not None else ()), *(() if len(r) < 8 else (tuple(r[7] if r[7] is not None else ()),)))


def entries_of(reference: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The columns of the list that count, with the array `aliases` of the names given in aliases (ref_id, alias)."""
    out = reference.select(*_COLUMNS).where("canonical_name is not null and ref_id is not null").withColumn("ref_id", F.col("ref_id").cast("int"))
    if aliases is None:
        return out.withColumn("aliases", F.array().cast("array<string>"))
    named = aliases.where("alias <> ''").groupBy(F.col("ref_id").cast("int").alias("ref_id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return out.join(named, "ref_id", "left")


def read_entries(reference: DataFrame, aliases: DataFrame | None = None, limit: int = MAX_ENTRIES) -> list[Entry] | None:
    """The entries with their acronyms, or None if there are more than `limit`."""
    rows = entries_of(reference, aliases).limit(limit + 1).collect()
    return None if len(rows) > limit else told_apart(sorted((_entry(r) for r in rows), key=lambda e: e.ref_id))


def _with_acronyms(entries: DataFrame) -> DataFrame:
    """The same as told_apart for a list of any length."""

    def mapped(of: Callable[[Entry], Iterable[tuple]], columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if rows := [r for e in map(_entry, b.itertuples(index=False, name=None)) for r in of(e)]:
                    yield pd.DataFrame(rows, columns=columns)

        return run

    votes = entries.mapInPandas(mapped(lambda e: [(r,) for r in rule_votes(e)], ["rule"]), "rule string")
    rules = acronym_rules(Counter({r[0]: r[1] for r in votes.groupBy("rule").count().collect()}))
    own = cut(entries.mapInPandas(mapped(lambda e: [(e.ref_id, *p) for p in proposed(e, rules)], ["ref_id", "a", "short"]), "ref_id int, a string, short boolean"))
    fit = own.groupBy("a").agg(F.max("short").alias("given"), F.count_if(~F.col("short")).alias("made"))
    kept = own.join(fit, "a").where(F.col("short") | (~F.col("given") & (F.col("made") == 1))).groupBy("ref_id").agg(F.array_sort(F.collect_set("a")).alias("acronyms"))
    return entries.join(kept, "ref_id", "left")


_INDEX: list[tuple] = []


def _index(entries: list[Entry]) -> ReferenceIndex:
    """The index of the entries this Python worker used last."""
    if not _INDEX or _INDEX[0][0] is not entries:
        _INDEX[:] = [(entries, ReferenceIndex(entries))]
    return _INDEX[0][1]


def _found(values: DataFrame, entries: list[Entry]) -> DataFrame:
    shared = values.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            index = _index(shared.value)
            yield pd.DataFrame({"value": b["value"], "hits": [_rows(index.hits(v)) for v in b["value"]]})

    return values.mapInPandas(run, f"value string, hits {_HITS}")


def _rows(hits: list[Hit]) -> list[dict]:
    return [{"stage": s, "distance": d, "ref_id": r, "acronym": a} for s, d, r, a in hits]


def _found_in_blocks(values: DataFrame, entries: DataFrame, max_entries: int, per_task: int = VALUES_PER_BLOCK) -> DataFrame:
    """The same for a list of any length: blocks of it stand before the values that pass them, in one partition."""
    entries = cut(_with_acronyms(entries))
    blocks = max(1, -(-entries.count() // max(1, max_entries)))
    copies = max(1, -(-values.count() // per_task))
    held = entries.select(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("role"), F.lit("").alias("value"), *[F.col(c) for c in entries.columns])
    none = [F.lit(None).cast(t).alias(c) for c, t in entries.dtypes]
    passed = values.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("value"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("role"), "value", *none)
    names = list(entries.columns)
    order = [names.index(c) for c in (*_COLUMNS, "aliases", "acronyms")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block, index = None, [], None
        for b in batches:
            out = []
            for at, copy, role, value, *entry in b.itertuples(index=False, name=None):
                if (at, copy) != now:
                    now, block, index = (at, copy), [], None
                if role == 0:
                    block.append(_entry([entry[k] for k in order]))
                    continue
                if index is None:
                    index = ReferenceIndex(block)
                if hits := index.hits(value):
                    out.append((value, _rows(hits)))
            if out:
                yield pd.DataFrame(out, columns=["value", "hits"])

    keys = ["block", "copy"]
    hits = held.unionByName(passed).repartition(*keys).sortWithinPartitions(*keys, "role").mapInPandas(run, f"value string, hits {_HITS}")
    return hits.groupBy("value").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def _search(values: DataFrame, reference: DataFrame, aliases: DataFrame | None, max_entries: int) -> DataFrame:
    """(value, hits) of distinct values; hits of every reading that some block found."""
    few = read_entries(reference, aliases, max_entries)
    return _found(values, few) if few is not None else _found_in_blocks(values, entries_of(reference, aliases), max_entries)


def _distinct(df: DataFrame, value: str) -> DataFrame:
    return spread(df.select(F.col(value).alias("value")).where("value <> ''").distinct(), "value")


def reference_hits(df: DataFrame, value: str, reference: DataFrame, aliases: DataFrame | None = None, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(value, ref_id, distance, acronym): for each distinct value all entries within the distances allowed, in its first reading that finds any.

    acronym: the acronym that the value was corrected to, else ''. Values without entry have no row. aliases: (ref_id, alias), more names of entries.
    """
    hits = _search(_distinct(df, value), reference, aliases, max_entries)
    least = F.array_min(F.transform("hits", lambda h: h["stage"]))
    hits = hits.select("value", F.explode(F.filter("hits", lambda h: h["stage"] == least)).alias("h"))
    return hits.select("value", "h.ref_id", "h.distance", "h.acronym")


def nearest(hits: Column | str) -> Column:
    """The nearest of an array of hits: earliest reading, least distance, smallest id; null if two acronyms are equally near."""
    best = F.array_min(F.transform(hits, lambda h: F.struct(h["stage"], h["distance"], h["ref_id"])))
    unclear = F.size(F.array_distinct(F.transform(hits, lambda h: h["acronym"]))) > 1
    return F.when(~((best["stage"] == NEAR_ACRONYM) & unclear), best)


def nearest_of(values: DataFrame, reference: DataFrame, aliases: DataFrame | None = None, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(value, ref_id, distance) of those of the distinct strings `value` that have a nearest entry."""
    found = _search(values, reference, aliases, max_entries).select("value", nearest("hits").alias("h"))
    return found.where("h is not null").select("value", "h.ref_id", "h.distance")


def nearest_reference(df: DataFrame, value: str, reference: DataFrame, ref_id: str = "ref_id", distance: str = "distance", max_entries: int = MAX_ENTRIES, aliases: DataFrame | None = None) -> DataFrame:
    """df with the ref_id of the entry nearest to each value (0: unmatched) and its distance."""
    out = df.drop(ref_id, distance)
    own, key, hit = out.columns, fresh(out, "_value"), fresh(out, "_hit")
    found = nearest_of(_distinct(df, value), reference, aliases, max_entries).select(F.col("value").alias(key), F.struct("ref_id", "distance").alias(hit))
    out = out.join(found, F.col(f"`{value}`") == F.col(key), "left")
    return out.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(hit)["ref_id"], F.lit(0)).alias(ref_id), F.col(hit)["distance"].alias(distance))


__all__ = ["Entry", "ReferenceIndex", "nearest_of", "nearest_reference", "read_entries", "reference_hits"]
