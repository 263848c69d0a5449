"""Variant spellings of bodies typed by people: merge-and-rematch resolution.

A spelling is read into a form: its generic words (what kind of body), its name words (nicknames as the full name) and the
initials that stand for name words. Spellings of one form, and those that a reference entry explains, start as one profile; each
keeps its own form, so that listed profiles are blocked and matched like all others. Two profiles of different entries never join.

Two forms match if they are of one kind and their names pair off within the typing errors allowed, a name of one side standing
against its initial on the other; initials left over must be the same on both sides. Names that two joined forms know only
together make a richer form: the profile carries the union of its spellings, names and initials, and re-enters blocking with it.

A round blocks every profile under the keys of all its forms, matches it in each block with the block's heaviest unlisted profile
and with the listed ones, and lets it join the heaviest match, listed ones first. When a round joins nothing, the profiles that
still share a block with others settle: the forms of each block are laid out in tiles, every two tiles that hold different
profiles are compared in one task, matches alone leave it, and what they join goes through the rounds again. At the end no two
matching forms of different profiles are left in any block. An initial that could stand for two bodies joins none.

A block is reduced by an aggregate to its heads in the rounds; in settling, blocks of the same forms are compared once, and no
pair is written that does not match.

Cases: null and empty spellings are no records; placeholders, degrees and bare ids stay unlinked; a spelling of generic words
only is named by them; equal spellings are one record whose weights add up; ties go to the smaller id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.automaton import distance
from rollbook.llm.canonical import MAX_ENTRIES, nearest_of
from rollbook.llm.names import allowance, generic, read_name
from rollbook.session import cut, spread

# Kinds that a "U." for university stands beside; placeholders that denote nothing; short forms of given names.
BESIDE_UNIVERSITY = frozenset("technical catholic medical agricultural naval european national".split())
PLACEHOLDERS = frozenset(("yes", "no", "unknown", "tbc", "none", "n a", "see cv", "cv see", "not applicable", "self taught", "not stated", "applicable not", "na", "a n", "not recorded", "various", "private", "other"))
NICKNAMES = {
    "alex": "alexander", "andy": "andrew", "bill": "william", "bob": "robert", "charlie": "charles", "chris": "christopher", "dan": "daniel", "dave": "david", "dick": "richard",
    "ed": "edward", "fred": "frederick", "greg": "gregory", "jim": "james", "joe": "joseph", "jack": "john", "kate": "katherine", "liz": "elizabeth", "larry": "lawrence", "maggie": "margaret",
    "matt": "matthew", "mike": "michael", "nick": "nicholas", "peggy": "margaret", "pete": "peter", "phil": "philip", "rob": "robert", "ron": "ronald", "sam": "samuel", "steve": "stephen",
    "sue": "susan", "ted": "edward", "tim": "timothy", "tom": "thomas", "tony": "anthony", "will": "william", "willy": "william", "hans": "johannes", "heinz": "heinrich", "fritz": "friedrich", "sepp": "josef",
}
#: Forms of a block that one side of a comparison holds.
TILE = 256
_BRACKETED = re.compile(r"\(([A-Z]{3,6})\)\s*$")


def form_of(text: str, nicknames: Mapping[str, str] = NICKNAMES) -> tuple[str, list[str], list[str]] | None:
    """(kind, sorted name words, initials), or None if the spelling denotes nothing."""
    words = read_name(text).words
    if len(words) > 2 and (m := _BRACKETED.search(text)) and words[-1] == m[1].lower() and _abbreviates(words[-1], words[:-1]):
        words = words[:-1]
    if not words or " ".join(words) in PLACEHOLDERS:
        return None
    kinds, names, initials = set(), [], []
    for w in words:
        g = generic(w)
        if len(w) == 1 and len(words) > 1 and w.isalpha():
            initials.append(w)
        elif g:
            kinds.add(g)
        else:
            names.append(nicknames.get(w, w))
    if "u" in initials and kinds <= BESIDE_UNIVERSITY:
        kinds.add("university")
        initials.remove("u")
    if {"administration", "school"} <= kinds:
        kinds.discard("national")
    if "conservatory" in kinds:
        kinds.discard("music")
    if not names:
        if len(kinds) < 2:
            return None
        names, kinds = list(kinds), set()
    return " ".join(sorted(kinds)), sorted(set(names)), sorted(initials)


def _abbreviates(acronym: str, words: tuple[str, ...]) -> bool:
    """Whether the letters of the acronym follow one another in the words, the first letter first."""
    letters = iter("".join(words))
    return acronym[0] == words[0][0] and all(c in letters for c in acronym)


def deletions(word: str, depth: int) -> set[str]:
    """The word and all words made by deleting up to `depth` characters."""
    out, last = {word}, {word}
    for _ in range(depth):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


@lru_cache(maxsize=5_000)
def _left(name: str) -> frozenset[str]:
    return frozenset(deletions(name, allowance(name)))


def block_keys(names: list[str], initials: list[str]) -> dict[str, frozenset[str]]:
    """Two forms of one kind that match share a key, (letters, word): of one name what is left after the deletions its errors allow, of the other parts the first letters.

    (Only forms of several names in which the first letters of two names are mistyped can miss each other.)
    """
    out: dict[str, frozenset[str]] = {}
    for i, name in enumerate(names):
        letters = "".join(sorted([*(n[0] for n in names[:i] + names[i + 1 :]), *initials]))
        out[letters] = out[letters] | _left(name) if letters in out else _left(name)
    return out


@lru_cache(maxsize=200_000)
def _apart(x: str, y: str) -> int | None:
    """Typing errors between two names, None if more than allowed."""
    d = distance(x, y, limit := allowance(max(x, y, key=len)))
    return d if d <= limit else None


def combine(a_names: list[str], a_initials: list[str], b_names: list[str], b_initials: list[str]) -> tuple[list[str], list[str]] | None:
    """(names, initials) known of a body by two forms of one kind, or None if they do not match."""
    if len(a_names) + len(a_initials) != len(b_names) + len(b_initials):
        return None
    left, paired, alone = list(b_names), [], []
    for x in sorted(a_names, key=len, reverse=True):
        near = [(d, y) for y in left if (d := _apart(x, y)) is not None]
        if near:
            y = min(near)[1]
            left.remove(y)
            paired.append((x, y))
        else:
            alone.append(x)
    if not paired or (a_initials or b_initials) and sum(x[0] != y[0] for x, y in paired) > (len(paired) == 1):
        return None
    a_left, b_left = list(a_initials), list(b_initials)
    for names, letters in ((alone, b_left), (left, a_left)):
        for n in names:
            if n[0] not in letters:
                return None
            letters.remove(n[0])
    return (sorted([*(x for x, _ in paired), *alone, *left]), sorted(a_left)) if sorted(a_left) == sorted(b_left) else None


def _read_forms(spellings: DataFrame) -> DataFrame:
    """spelling, weight, ref_id -> the same with kind, names, initials; unreadable ones without reference are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [form_of(s) for s in b["spelling"]]
            b["kind"] = [r[0] if r else None for r in read]
            b["names"] = [r[1] if r else [] for r in read]
            b["initials"] = [r[2] if r else [] for r in read]
            yield b

    out = spellings.mapInPandas(run, "spelling string, weight bigint, ref_id int, kind string, names array<string>, initials array<string>")
    return out.where("ref_id > 0 or kind is not null")


def _keys(forms: DataFrame) -> DataFrame:
    """(form, body, key) of the block keys of the readable forms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, o, k, letters, list(words)) for f, o, k, n, i in zip(b["form"], b["body"], b["kind"], b["names"], b["initials"]) for letters, words in block_keys(list(n), list(i)).items()]
            for i in range(0, len(rows), 2_000):
                yield pd.DataFrame(rows[i : i + 2_000], columns=["form", "body", "kind", "letters", "words"])

    readable = forms.where("kind is not null").select("form", "body", "kind", "names", "initials")
    words = readable.mapInPandas(run, "form bigint, body bigint, kind string, letters string, words array<string>")
    return words.select("form", "body", "kind", "letters", F.explode("words").alias("word")).select("form", "body", F.xxhash64("kind", "letters", "word").alias("key"))


def _shared(keys: DataFrame) -> DataFrame:
    """(form, key) of the keys that forms of more than one starting profile have."""
    shared = keys.groupBy("key").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("key")
    return keys.drop("body").join(shared, "key", "left_semi")


def _united() -> Column:
    """Of two forms: null if they do not match, else names and initials that only both together know; no names if nothing is new."""

    def run(a: pd.Series, ai: pd.Series, b: pd.Series, bi: pd.Series) -> pd.DataFrame:
        out = []
        for w, x, y, z in zip(a, ai, b, bi):
            both = combine(list(w), list(x), list(y), list(z))
            richer = both is not None and len(both[0]) > max(len(w), len(y))
            out.append((both is not None, both[0] if richer else [], both[1] if richer else []))
        return pd.DataFrame(out, columns=["good", "names", "initials"])

    return F.pandas_udf(run, "good boolean, names array<string>, initials array<string>")


def resolve(spellings: DataFrame, reference: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(spelling, weight) -> (spelling, body): spellings of one body carry the same body id.

    spellings: strings `spelling`, repeats add up their bigint `weight`. reference: entries whose alias paths open profiles.
    """
    pool = spellings.where("spelling is not null and spelling <> ''").groupBy("spelling").agg(F.sum("weight").alias("weight"))
    pool = cut(spread(pool, "spelling"))
    if reference is None:
        pool = pool.withColumn("ref_id", F.lit(0))
    else:
        found = nearest_of(pool.select(F.col("spelling").alias("value")), reference, max_entries=MAX_ENTRIES)
        pool = spread(pool.join(found.select(F.col("value").alias("spelling"), "ref_id"), "spelling", "left").fillna(0, ["ref_id"]), "spelling")
    read = _read_forms(pool.select("spelling", "weight", "ref_id"))
    listed = F.col("ref_id") > 0
    form = F.when(listed, F.xxhash64("kind", "names", "initials", "ref_id", F.lit("ref"))).otherwise(F.xxhash64("kind", "names", "initials"))
    read = cut(read.withColumn("form", form))
    start = F.when(listed, F.xxhash64("ref_id", F.lit("ref"))).otherwise(F.col("form"))
    forms = read.groupBy("form").agg(F.sum("weight").alias("weight"), *[F.first(c).alias(c) for c in ("ref_id", "kind", "names", "initials")])
    # turn: the last turn in which the profile of the form changed.
    state = cut(spread(forms.withColumn("body", start).withColumn("turn", F.lit(0)), "form"))
    everything = cut(_keys(state))
    keys = cut(_shared(everything))
    turn = settled = 0
    while True:  # every turn but the last leaves fewer profiles
        joined, richer = _round(state, _changed_blocks(state, keys, turn))
        if joined is None:
            joined, richer = _settled(state, keys, settled, tile)
            settled = turn + 1
            if joined is None:
                break
        turn += 1
        moved = cut(joined.unionByName(joined.select(F.col("root").alias("body"), "root").distinct()))
        known = state.select("form")
        state = state.join(moved, "body", "left").withColumn("turn", F.when(F.col("root").isNull(), F.col("turn")).otherwise(turn)).withColumn("body", F.coalesce("root", "body")).drop("root")
        added = richer.join(moved, "body", "left").withColumn("body", F.coalesce("root", "body")).drop("root").join(known, "form", "left_anti")
        added = cut(added.groupBy("form").agg(*[F.first(c).alias(c) for c in ("kind", "names", "initials")], F.min("body").alias("body"), F.max("ref_id").alias("ref_id")))
        if not added.isEmpty():
            state = state.unionByName(added.withColumn("weight", F.lit(0).cast("bigint")).withColumn("turn", F.lit(turn)))
            more = cut(_keys(added))
            everything = everything.unionByName(more)
            fresh = more.select("key").distinct()
            keys = cut(keys.join(fresh, "key", "left_anti").unionByName(_shared(everything.join(fresh, "key", "left_semi"))))
        state = cut(state)
    return read.select("spelling", "form").join(state.select("form", "body"), "form").select("spelling", "body")


def _changed_blocks(state: DataFrame, keys: DataFrame, turn: int) -> DataFrame:
    """The keys of the blocks that hold a profile changed in this turn or later; the others would give again what they gave before."""
    if not turn:
        return keys
    hit = keys.join(state.where(F.col("turn") >= turn).select("form"), "form", "left_semi").select("key").distinct()
    return keys.join(hit, "key", "left_semi")


def _forms(state: DataFrame, k: str) -> DataFrame:
    return state.select(*[F.col(c).alias(f"{k}{c}") for c in ("form", "kind", "names", "initials")])


def _judged(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs (form, body, p_form, ...) that match, with `united`, the form that only both together know."""
    shown = pairs.join(_forms(state, ""), "form").join(_forms(state, "p_").drop("p_kind"), "p_form")
    return cut(shown.withColumn("united", _united()("names", "initials", "p_names", "p_initials")).where("united.good").drop("names", "initials", "p_names", "p_initials"))


def _richer(good: DataFrame) -> DataFrame:
    """(form, body, ref_id, kind, names, initials): the forms that only two joined ones together know, of the profile of one of them."""
    new = good.where(F.size("united.names") > 0).select("body", F.lit(0).alias("ref_id"), "kind", "united.names", "united.initials")
    return new.select(F.xxhash64("kind", "names", "initials").alias("form"), "*").distinct()


def _round(state: DataFrame, keys: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """((body, root) of the profiles that join, richer forms): each joins its heaviest match among the heads of its blocks, heavier than itself.

    Listed profiles rank above all others and have no parent, so a tree of parents holds one entry at most.
    """
    weights = state.groupBy("body").agg(F.sum("weight").alias("w"), F.max("ref_id").alias("ref"))
    rank = F.struct((F.col("ref") > 0).alias("listed"), "w", "body").alias("rank")
    short = F.size("initials") > 0
    profiles = state.join(weights, "body").select("form", "body", short.alias("short"), "ref", rank, "weight")
    entered = keys.join(profiles, "form")
    # Of each block: the heaviest unlisted and every listed profile with its heaviest form there, and whether an initial could mean two profiles.
    whole = F.when(~F.col("short"), F.col("body"))
    heads = entered.groupBy("key", "ref").agg(
        F.max(F.struct("rank", "weight", "form", "short")).alias("head"), F.min("body").alias("low"), F.max("body").alias("high"),
        F.min(whole).alias("low_whole"), F.max(whole).alias("high_whole"),
    ).groupBy("key").agg(
        F.collect_list("head").alias("heads"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("low_whole").alias("low_whole"), F.max("high_whole").alias("high_whole"),
    ).where("low <> high")
    heads = heads.select("key", F.explode("heads").alias("head"), F.coalesce(F.col("low_whole") == F.col("high_whole"), F.lit(True)).alias("single"))
    met = entered.where("ref = 0").join(heads, "key").where(F.col("rank") < F.col("head.rank")).where(~F.col("short") & ~F.col("head.short") | F.col("single"))
    pairs = met.select("form", "body", F.col("head.form").alias("p_form"), F.col("head.rank").alias("p_rank")).distinct()
    good = _judged(pairs, state)
    return _roots(good.groupBy("body").agg(F.max("p_rank").alias("best")).select("body", F.col("best.body").alias("parent"))), _richer(good)


def _settled(state: DataFrame, keys: DataFrame, since: int, tile: int) -> tuple[DataFrame | None, DataFrame]:
    """The same for all matching forms of different profiles left in any block, one of them changed since the turn `since`.

    A profile joins the heaviest profile it matches that is heavier than itself; what is left over joins in the next turn.
    """
    if since:
        # What an initial may mean is told by all blocks of its form.
        near = _changed_blocks(state, keys, since)
        told = near.join(state.where(F.size("initials") > 0).select("form"), "form", "left_semi").select("form").distinct()
        keys = cut(keys.join(near.unionByName(keys.join(told, "form", "left_semi")).select("key").distinct(), "key", "left_semi"))
    weights = state.groupBy("body").agg(F.sum("weight").alias("w"), F.max("ref_id").alias("ref"))
    profiles = state.join(weights, "body").select("form", "body", "ref", F.struct((F.col("ref") > 0).alias("listed"), "w", "body").alias("rank"), "names", "initials")
    entered = keys.join(profiles.select("form", "body"), "form")
    open_ = entered.groupBy("key").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    placed = entered.join(open_.select("key", tiles.alias("tiles")), "key").withColumn("t", F.pmod(F.xxhash64("form"), F.col("tiles")).cast("int"))
    held = placed.groupBy("key", "tiles", "t").agg(F.array_sort(F.collect_list("form")).alias("own"))
    left = held.select("key", "own", "t", F.explode(F.sequence(F.col("t"), F.col("tiles") - 1)).alias("u"))
    met = left.join(held.select("key", F.col("t").alias("u"), F.col("own").alias("other")), ["key", "u"]).select("own", "other").distinct()
    met = cut(met.withColumn("id", F.xxhash64("own", "other")))
    # The forms of the tiles, each read once.
    shape = F.struct("form", "body", "ref", "names", "initials").alias("f")
    sides = met.select("id", F.explode("own").alias("form"), F.lit(0).alias("side")).unionByName(met.select("id", F.explode("other").alias("form"), F.lit(1).alias("side")))
    filled = sides.join(profiles.select("form", shape), "form").groupBy("id").agg(
        *[F.collect_list(F.when(F.col("side") == k, F.col("f"))).alias(f"s{k}") for k in (0, 1)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own, other in zip(b["s0"], b["s1"]):
                own, other = ([(f["form"], f["body"], f["ref"], list(f["names"]), list(f["initials"])) for f in s] for s in (own, other))
                for x, a, ref, names, initials in own:
                    for y, c, other_ref, others, letters in other:
                        if a != c and not (ref and other_ref) and combine(names, initials, others, letters):
                            out += [(x, a, y, c), (y, c, x, a)]
            if out:
                yield pd.DataFrame(sorted(set(out)), columns=["form", "body", "p_form", "p_body"])

    pairs = spread(filled, "id").mapInPandas(run, "form bigint, body bigint, p_form bigint, p_body bigint").distinct()
    # An initial that stands against the names of two profiles means neither.
    short = state.select("form", (F.size("initials") > 0).alias("short"), (F.col("turn") >= since).alias("new"))
    pairs = cut(pairs.join(short, "form").join(short.select(F.col("form").alias("p_form"), F.col("short").alias("p_short"), F.col("new").alias("p_new")), "p_form"))
    meant = pairs.where("not p_short").groupBy("form").agg((F.min("p_body") < F.max("p_body")).alias("unclear"))
    pairs = pairs.join(meant.where("unclear").select("form", "unclear"), "form", "left").join(meant.where("unclear").select(F.col("form").alias("p_form"), F.col("unclear").alias("p_unclear")), "p_form", "left")
    clear = cut(pairs.where("(new or p_new) and (not short or unclear is null) and (not p_short or p_unclear is null)").select("form", "body", "p_form", "p_body"))
    good = _judged(clear, state)
    rank = lambda k: weights.select(F.col("body").alias(f"{k}body"), F.struct((F.col("ref") > 0).alias("listed"), "w", "body").alias(f"{k}rank"), F.col("ref").alias(f"{k}ref"))
    up = good.select("body", "p_body").distinct().join(rank(""), "body").join(rank("p_"), "p_body").where("ref = 0 and rank < p_rank")
    return _roots(up.groupBy("body").agg(F.max("p_rank").alias("best")).select("body", F.col("best.body").alias("parent"))), _richer(good)


def _roots(links: DataFrame) -> DataFrame | None:
    """(body, root) of a forest of parent links by pointer jumping, or None without links."""
    current = cut(links.select("body", F.col("parent").alias("root")))
    if current.isEmpty():
        return None
    while True:
        up = current.select(F.col("body").alias("root"), F.col("root").alias("above"))
        jumped = current.join(up, "root", "left").select("body", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        jumped = cut(jumped)
        if jumped.where("moved").isEmpty():
            return jumped.select("body", "root")
        current = jumped.select("body", "root")
