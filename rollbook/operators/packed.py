"""Several values packed in one cell: dictionary-guided segmentation.

Known whole values are learned from the cells themselves: quoted values, cells without any delimiter and the pieces between
delimiters that hardly occur inside values vote for a dictionary with counts; a second pass recounts the pieces of a first
segmentation. A multi-pattern automaton finds the known values in a cell. For every set of delimiter kinds that may separate
values in the cell, a dynamic program covers the cell with known and unknown values at least cost; the cheapest set wins.
A delimiter inside a value is kept when it is quoted, escaped by a backslash, not of a separating kind, or when the known
value (or the filled template of known values) it belongs to is cheaper than its pieces, however many pieces that are.

A dictionary of at most `max_broadcast` values is held by every task. A larger one is cut into shards by the first word of its
values, hot first words once more by the whole value; a cell travels to the shards of the words that begin its pieces, the
automaton of each shard reports the known values in it, and names and templates are tables joined in. Either way the same
values, templates and names reach the same dynamic program, so that the rows do not depend on the way.

Cases: null, empty and blank cells give no rows; empty pieces are left out; repeats are kept; text without known values
splits at the delimiters whose pieces cost least, that is as rarely as its own layout allows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import combinations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.session import cut, fresh, spread

# Delimiter kinds, quotation marks.
KINDS = ("||", "|", ";", ",", "/", "•", "\n", "\t")
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
STRONG = ("||", "•", "\n", "\t")

_MARK = re.compile(r"\|\||\||;|,|(?<=\s)/(?=\s)|•|\n|\t")
_DATED = re.compile(r"\s*\((?:from )?\d{4}-\d{2}-\d{2}(?: to \d{4}-\d{2}-\d{2})?\)$")
_INNER_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_ESCAPED = re.compile(r"\\([|;,/•\n\t\\])")
_BARE_ID = re.compile(r"Q\d+$")
#: Cost of a value outside the dictionary (and of each of its characters), of a separating kind, and of a known value that keeps a separating delimiter unprotected.
UNKNOWN, PER_CHARACTER, PER_KIND, UNPROTECTED = 8.0, 1.0, 1.5, 9.0
#: Dictionary values held by each task at once; a larger dictionary is searched shard by shard.
MAX_BROADCAST_VALUES = 200_000
#: Cells that one task takes through a shard; the shard is repeated for more.
CELLS_PER_SHARD = 200_000


def key_of(value: str) -> str:
    """A value without its dates; the dictionary holds keys."""
    return _DATED.sub("", value) if value.endswith(")") else value


_SPACES = " \u00a0\u2009\u202f"
# Everything that can matter for a cut: escaped characters, delimiters, opening quotation marks.
_SPECIAL = re.compile(r"\\.|\|\||\||;|,|(?<=\s)/(?=\s)|•|\n|\t|[\"“«„]", re.DOTALL)
# A word that can be a name, never across a delimiter, quotation mark or bracket: the words of a span are those of its cell.
_TOKEN = re.compile(r"[^\s|;,/•()\[\]\"“”«»„:\\'.][^\s|;,/•()\[\]\"“”«»„:\\]*(?<![.'])")
# What a known value begins with up to the first character that may end one.
_RUN = re.compile(r"[^\s|;,/•()\"“”«»„\\]*")
_BEGIN = re.compile(r"(?:^|\\.|[|;,/•\n\t\"“”«»„(])\s*", re.DOTALL)

Piece = tuple[int, int, bool, str]


def _closing(cell: str, start: int, kinds: frozenset[str]) -> int:
    """Index after the quotation mark that closes the one at `start`, or -1 if what follows is no separator."""
    close = QUOTES[cell[start]]
    i = start + 1
    while (at := cell.find(close, i)) >= 0:
        if close == '"' and cell[at + 1 : at + 2] == '"':
            i = at + 2
            continue
        after = cell[at + 1 :].lstrip(_SPACES)
        return at + 1 if not after.strip() or any(after.startswith(k) for k in kinds) else -1
    return -1


def _specials(cell: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in _SPECIAL.finditer(cell)]


def _pieces(cell: str, kinds: frozenset[str], specials: list[tuple[int, int, str]] | None = None) -> list[Piece]:
    """(begin, end, quoted, separator after it) of the pieces of the cell cut at every unprotected delimiter of the given kinds."""
    out, begin, skip = [], 0, 0
    quoted = False
    for start, end, mark in _specials(cell) if specials is None else specials:
        if start < skip:
            continue
        if mark in kinds:
            out.append((begin, start, quoted, mark))
            begin, quoted = end, False
        elif mark in QUOTES and not quoted and not cell[begin:start].strip() and (after := _closing(cell, start, kinds)) > 0:
            quoted, skip = True, after
    out.append((begin, len(cell), quoted, ""))
    return out


def bare(raw: str, quoted: bool) -> str:
    """The value of a raw piece: no outer white space, quotes around it or protecting marks."""
    text = raw.strip()
    if quoted:
        inner = text[1:-1]
        text = (inner.replace('""', '"') if text[0] == '"' else inner).strip()
    return _ESCAPED.sub(r"\1", text).strip() if "\\" in text else text


def _bare_parts(text: str, kinds: Iterable[str], specials: list[tuple[int, int, str]] | None = None) -> Iterator[tuple[str, bool]]:
    """(value, quoted) of the pieces of a text cut at the given kinds."""
    for begin, end, quoted, _ in _pieces(text, frozenset(kinds), specials):
        yield bare(text[begin:end], quoted), quoted


def present_kinds(cell: str) -> list[str]:
    found = {m[0] for m in _MARK.finditer(cell)}
    return [k for k in KINDS if k in found]


def slots(key: str) -> Iterator[tuple[str, str]]:
    """(key with one capitalised word blanked, that word): words that fill one slot of several keys may be names."""
    if " " in key:
        for m in _TOKEN.finditer(key):
            if len(m[0]) > 2 and m[0][0].isupper():
                yield f"{key[: m.start()]}_{key[m.end() :]}", m[0]


def blanked(text: str, names: set[str] | frozenset[str]) -> str:
    """The text with its names as blanks."""
    return _TOKEN.sub(lambda m: "_" if m[0] in names else m[0], text)


class Scorer:
    """Cost of values: the negative log probability of a known value, of a template with names in its slots, or of unknown text.

    `counts` maps known keys to their counts. A capitalised word that fills, among others, a slot of a productive template
    ("councillor of _, ward 4") counts as a name; a key with its names blanked is its template. A key or template that holds
    delimiters is taken as a value only if it is not much rarer than its pieces: values that merely stand side by side are.
    Names, templates and the number of names come out of the counts; a scorer of one cell of a large dictionary is given them.
    """

    FILLERS, SHARE = 4, 0.3

    def __init__(self, counts: Mapping[str, float], total: float, names: set[str] | None = None, templates: dict[str, float] | None = None, n_names: int = 0) -> None:
        self.counts, self.total = counts, max(total, 1.0)
        if names is None or templates is None:
            fillers: dict[str, set[str]] = {}
            for key in counts:
                for slot, word in slots(key):
                    fillers.setdefault(slot, set()).add(word)
            names = {w for ws in fillers.values() if len(ws) >= self.FILLERS for w in ws}
            n_names, templates = len(names), {}
            for key, n in counts.items():
                t = blanked(key, names)
                templates[t] = templates.get(t, 0.0) + n
        self.names, self.templates, self.per_name = names, templates, math.log(n_names + 2)
        self.memo: dict[str, float] = {}
        self.keys_found = _automaton(counts)
        self.templates_found = _automaton(t for t, n in templates.items() if n >= 2 and "_" in t)

    def _whole(self, text: str, table: Mapping[str, float], of: Callable[[str], str]) -> bool:
        kinds = present_kinds(text)
        if not kinds:
            return True
        parts = [of(value) for value, _ in _bare_parts(text, kinds)]
        return table.get(text, 0.0) >= self.SHARE * min((table.get(x, 0.0) for x in parts if x), default=0.0)

    def cost(self, key: str) -> float:
        if (known := self.memo.get(key)) is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[key] = self._cost(key)
        return known

    @staticmethod
    def unknown(key: str) -> float:
        return 3.0 if key[:1] == "Q" and _BARE_ID.match(key) else UNKNOWN + PER_CHARACTER * len(key)

    def _cost(self, key: str) -> float:
        best = self.unknown(key)
        if best == 3.0 or _INNER_DATE.search(key):
            return best
        template = blanked(key, self.names)
        if not self._whole(template, self.templates, lambda x: blanked(key_of(x), self.names)):
            return best
        if (n := self.templates.get(template, 0.0)) >= 2:
            best = min(best, math.log(self.total / n) + self.per_name * template.count("_"))
        if (n := self.counts.get(key, 0.0)) and self._whole(key, self.counts, key_of):
            best = min(best, math.log(self.total / n) + (0.0 if n >= 2 else 4.0))
        return best

    def spans(self, cell: str, begins: set[int], ends: set[int]) -> dict[int, list[int]]:
        """end -> begins of the known values and filled templates that fill the cell between two of the given places."""
        out: dict[int, list[int]] = {}
        for at, size in self.keys_found.iter(cell) if len(self.keys_found) else ():
            if at + 1 in ends and at + 1 - size in begins:
                out.setdefault(at + 1, []).append(at + 1 - size)
        words = [(m.start(), m.end()) for m in _TOKEN.finditer(cell) if m[0] in self.names] if len(self.templates_found) else ()
        if words:
            place: dict[int, int] = {}
            parts, done, shrunk = [], 0, 0
            marks = sorted(begins | ends)
            k = 0
            for a, b in [*words, (len(cell), len(cell))]:
                while k < len(marks) and marks[k] <= a:
                    place[marks[k] - shrunk] = marks[k]
                    k += 1
                if a < b:
                    parts += [cell[done:a], "_"]
                    done, shrunk = b, shrunk + b - a - 1
            parts.append(cell[done:])
            for at, size in self.templates_found.iter("".join(parts)):
                end, begin = place.get(at + 1), place.get(at + 1 - size)
                if end in ends and begin in begins:
                    out.setdefault(end, []).append(begin)
        return out


def _automaton(keys: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for key in keys:
        if key:
            a.add_word(key, len(key))
    a.make_automaton()
    return a


def _trimmed(cell: str, begin: int, end: int) -> tuple[int, int, int]:
    """Begin, end and end before its dates of cell[begin:end] without outer white space."""
    raw = cell[begin:end].rstrip()
    end = begin + len(raw)
    begin = end - len(raw.lstrip())
    undated = end
    if end > begin and cell[end - 1] == ")" and (at := cell.rfind("(", begin, end)) >= 0 and _DATED.match(cell, at, end):
        undated = at
        while undated > begin and cell[undated - 1].isspace():
            undated -= 1
    return begin, end, undated


Single = tuple[int, int, int, str, float]


def _single(cell: str, begin: int, end: int, quoted: bool, scorer: Scorer, spans: dict[int, list[int]]) -> Single:
    """Begin, end, end before its dates, value and cost of a piece taken as one value."""
    b, e, undated = _trimmed(cell, begin, end)
    value = cell[b:e]
    if quoted or "\\" in value:
        value = bare(value, quoted)
        return b, e, undated, value, scorer.cost(key_of(value)) if value else 0.0
    key = cell[b:undated]
    return b, e, undated, value, 0.0 if not value else scorer.cost(key) if b in spans.get(undated, ()) else scorer.unknown(key)


def _cover(cell: str, parts: list[Single], scorer: Scorer, spans: dict[int, list[int]]) -> tuple[float, list[str]]:
    """Least-cost cover of the pieces by values: a single piece, or neighbours that a known span joins, any number of them."""
    first = {p[0]: i for i, p in enumerate(parts)}
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end, (b, _, undated, _, single) in enumerate(parts):
        least = (best[end][0] + single, end)
        begins = spans.get(undated)
        for start in sorted({first[x] for x in begins if x < b and x in first}, reverse=True) if begins else ():
            joined = cell[parts[start][0] : undated]
            known = scorer.cost(joined)
            if known < scorer.unknown(joined) and (cost := best[start][0] + known + UNPROTECTED) < least[0]:
                least = (cost, start)
        best.append(least)
    out, end = [], len(parts)
    while end:
        start = best[end][1]
        joined = parts[start][3] if end - start == 1 else cell[parts[start][0] : parts[end - 1][1]]
        if joined:
            out.append(joined)
        end = start
    return best[-1][0], out[::-1]


def segment(cell: str | None, scorer: Scorer) -> list[str]:
    """Values of a cell in order."""
    if cell is None or not cell.strip():
        return []
    kinds, specials = present_kinds(cell), _specials(cell)
    if not kinds:
        _, _, quoted, _ = _pieces(cell, frozenset(), specials)[0]
        value = bare(cell, quoted)
        return [value] if value else []
    finest = [(0, 0, False, ""), *((s, e, False, m) for s, e, m in specials if m in KINDS)]
    places = [_trimmed(cell, a[1], b) for a, b in zip(finest, [*(p[0] for p in finest[1:]), len(cell)])]
    spans = scorer.spans(cell, {b for b, _, _ in places}, {u for _, _, u in places})
    singles: dict[tuple[int, int, bool], Single] = {}
    best: tuple[float, list[str]] | None = None
    seen: set[tuple] = set()
    for size in range(len(kinds) + 1):
        for chosen in combinations(kinds, size):
            pieces = _pieces(cell, frozenset(chosen), specials)
            shape = tuple(pieces)
            if shape in seen:
                continue
            seen.add(shape)
            parts = []
            for b, e, quoted, _ in pieces:
                if (part := singles.get((b, e, quoted))) is None:
                    part = singles[b, e, quoted] = _single(cell, b, e, quoted, scorer, spans)
                parts.append(part)
            cost, values = _cover(cell, parts, scorer, spans)
            fixed = PER_KIND * len({s for _, _, _, s in pieces if s})
            if best is None or cost + fixed < best[0] - 1e-9:
                best = (cost + fixed, values)
    return best[1] if best else []


def _votes(cell: str | None) -> Iterator[tuple[str, float]]:
    """(key, weight) of the values that can be told without a dictionary."""
    if cell is None or not cell.strip():
        return
    kinds, specials = present_kinds(cell), _specials(cell)
    strong = [k for k in kinds if k in STRONG]
    for value, quoted in _bare_parts(cell, strong, specials):
        if value:
            yield key_of(value), 1.0 if quoted or not present_kinds(value) else 0.4
    for kind in kinds:
        if kind not in STRONG:
            for value, quoted in _bare_parts(cell, [*strong, kind], specials):
                if value:
                    yield key_of(value), 1.0 if quoted else 0.4


def _counted(rows: DataFrame, run: Callable[[pd.DataFrame], Iterator[tuple[str, float]]], given: DataFrame | None) -> DataFrame:
    """(key, n) of the votes that `run` finds in each batch of rows, summed before the shuffle, with the values given beforehand."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tally: dict[str, float] = {}
            for key, weight in run(batch):
                if _BARE_ID.match(key) or _INNER_DATE.search(key):
                    continue  # never known: ids have a fixed cost, an inner date means two values
                tally[key] = tally.get(key, 0.0) + weight
            if tally:  # an empty string column has no Arrow array
                yield pd.DataFrame({"key": list(tally), "n": list(tally.values())})

    votes = rows.mapInPandas(mapped, "key string, n double").where("key <> ''")
    if given is not None:
        votes = votes.unionByName(given)
    return votes.groupBy("key").agg(F.sum("n").alias("n"))


def _collected(dictionary: DataFrame, limit: int) -> tuple[dict[str, float], float] | None:
    """The dictionary as a dict with its total, or None when it holds more than `limit` values."""
    head = dictionary.limit(limit + 1).toPandas()
    if len(head) > limit:
        return None
    head = head.sort_values("key")
    counts = dict(zip(head["key"], head["n"]))
    return counts, float(head["n"].sum())


#: The scorer of the dictionary that this Python worker used last.
_MODELS: list[tuple] = []


def _model(counts: dict[str, float], total: float) -> Scorer:
    if not _MODELS or _MODELS[0][0] is not counts:
        _MODELS[:] = [(counts, Scorer(counts, total))]
    return _MODELS[0][1]


Cutter = Callable[[pd.DataFrame], list[list[str]]]


def _prepared(cells: DataFrame, dictionary: DataFrame, limit: int) -> tuple[DataFrame, Cutter]:
    """Rows with the column `cell`, and the function that cuts a batch of them with the dictionary."""
    counts = _collected(dictionary, limit)
    if counts is None:
        return _searched(cells, dictionary, limit)
    shared = cells.sparkSession.sparkContext.broadcast(counts)

    def run(batch: pd.DataFrame) -> list[list[str]]:
        scorer = _model(*shared.value)
        return [segment(c, scorer) for c in batch["cell"]]

    return cells, run


def _searched(cells: DataFrame, dictionary: DataFrame, limit: int) -> tuple[DataFrame, Cutter]:
    """The same for a dictionary too large for a task: each cell with the values, templates and names that it can ask for."""
    names = cut(_names(dictionary))
    total, n_names = dictionary.agg(F.sum("n")).first()[0], names.count()
    keyed = cut(cells.select("cell", F.md5("cell").alias("id")))
    texts = _with_names(keyed.select("id", _plain("cell").alias("text")), "id", "text", names)
    keys = _with_names(dictionary.withColumn("id", F.md5("key")), "id", "key", names)
    templates = keys.groupBy(_blanked("key", "names").alias("text")).agg(F.sum("n").alias("n"))
    patterns = dictionary.select(F.lit("k").alias("kind"), F.col("key").alias("text"), "n").unionByName(templates.select(F.lit("t").alias("kind"), "text", "n"))
    scanned = texts.select("id", F.lit("k").alias("kind"), "text").unionByName(texts.select("id", F.lit("t").alias("kind"), _blanked("text", "names").alias("text")))
    hits = _search(patterns, scanned, limit)
    found = hits.groupBy("id").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("text", "n"))).alias(f"found_{k}") for k in "kt"])
    rows = keyed.join(found, "id", "left").join(texts.select("id", "names"), "id").drop("id")

    def run(batch: pd.DataFrame) -> list[list[str]]:
        out = []
        table = lambda pairs: {p["text"]: p["n"] for p in pairs} if pairs is not None else {}
        for cell, keys, templates, names in zip(batch["cell"], batch["found_k"], batch["found_t"], batch["names"]):
            out.append(segment(cell, Scorer(table(keys), total, set(names) if names is not None else set(), table(templates), n_names)))
        return out

    return rows, run


def _plain(column: str):
    """A cell and, if it holds protecting marks or doubled quotes, the cell without them: every value asked for is a part of it."""

    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([f"{c}\n{plain}" if (plain := _ESCAPED.sub(r"\1", c).replace('""', '"')) != c else c for c in cells])

    return F.pandas_udf(run, "string")(column)


def _blanked(text: str, names: str):
    def run(texts: pd.Series, named: pd.Series) -> pd.Series:
        return pd.Series([blanked(t, set(ns)) if ns is not None and len(ns) else t for t, ns in zip(texts, named)])

    return F.pandas_udf(run, "string")(text, names)


def _names(dictionary: DataFrame) -> DataFrame:
    """(word): words that fill, with enough others, one slot of the dictionary's keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if pairs := [p for key in b["key"] for p in slots(key)]:
                yield pd.DataFrame(pairs, columns=["slot", "word"])

    filled = dictionary.select("key").mapInPandas(run, "slot string, word string").distinct()
    productive = filled.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= Scorer.FILLERS)
    return filled.join(productive, "slot", "left_semi").select("word").distinct()


def _with_names(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """df with the array `names` of the names among the words of its text; key is unique."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({m[0] for m in _TOKEN.finditer(t) if len(m[0]) > 2 and m[0][0].isupper()}) for t in texts])

    words = df.select(key, F.explode(F.pandas_udf(run, "array<string>")(text)).alias("word"))
    named = words.join(names, "word").groupBy(key).agg(F.collect_list("word").alias("names"))
    return df.join(named, key, "left")


def _search(patterns: DataFrame, texts: DataFrame, limit: int, per_task: int = CELLS_PER_SHARD) -> DataFrame:
    """(id, kind, text, n): the patterns (kind, text, n) that begin after a delimiter or quotation mark of the texts (id, kind, text).

    A shard holds the patterns of some first words, at most `limit` of them: those of a hot word are cut by the whole pattern, and
    the texts with that word pass all its shards. The texts of a shard are dealt to as many copies of it as they need. A task reads
    the patterns of a shard, then streams the texts.
    """
    limit = max(1, limit)

    def first(values: pd.Series) -> pd.Series:
        return pd.Series([_RUN.match(v)[0] for v in values])

    def firsts(values: pd.Series) -> pd.Series:
        return pd.Series([sorted({_RUN.match(v, m.end())[0] for m in _BEGIN.finditer(v)}) for v in values])

    shards = max(1, -(-patterns.count() // limit))
    bucket = lambda run: F.pmod(F.xxhash64("kind", run), F.lit(shards)).alias("bucket")
    p = cut(patterns.select("kind", "text", "n", F.pandas_udf(first, "string")("text").alias("run")).select("kind", "text", "n", bucket("run")))
    t = texts.select("id", "kind", "text", F.explode(F.pandas_udf(firsts, "array<string>")("text")).alias("run"))
    t = cut(t.groupBy("id", "kind", bucket("run")).agg(F.any_value("text").alias("text")))
    pieces = lambda df, size, name: df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = cut(pieces(p, limit, "parts").join(pieces(t, per_task, "copies"), "bucket"))
    held = p.join(sizes, "bucket").select(
        "bucket", F.pmod(F.xxhash64("text"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("role"), F.lit("").alias("id"), "kind", "text", "n")
    passed = t.join(sizes, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", "kind"), "copies").cast("int").alias("copy"), F.lit(1).alias("role"), "id", "kind", "text", F.lit(0.0).alias("n"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, machines = None, {}, None
        for b in batches:
            out = []
            for bucket, part, copy, role, i, kind, text, n in b[["bucket", "part", "copy", "role", "id", "kind", "text", "n"]].itertuples(index=False, name=None):
                if (bucket, part, copy) != now:
                    now, held, machines = (bucket, part, copy), {}, None
                if role == 0:
                    held.setdefault(kind, {})[text] = n
                    continue
                if machines is None:
                    machines = {k: _automaton(v) for k, v in held.items()}
                if kind in machines and len(machines[kind]):
                    for hit in {text[at + 1 - size : at + 1] for at, size in machines[kind].iter(text)}:
                        out.append((i, kind, hit, held[kind][hit]))
            if out:
                yield pd.DataFrame(out, columns=["id", "kind", "text", "n"])

    keys = ["bucket", "part", "copy"]
    return held.unionByName(passed).repartition(*keys).sortWithinPartitions(*keys, "role").mapInPandas(scan, "id string, kind string, text string, n double")


def split_packed(df: DataFrame, cell: str, extra_values: DataFrame | None = None, pos: str = "pos", val: str = "val", max_broadcast: int = MAX_BROADCAST_VALUES) -> DataFrame:
    """One row per value of the packed cell, with its place from 1, beside all other columns of df.

    extra_values: one string column of values known beforehand; each counts as seen twice. Equal cells are cut once.
    """
    cell_ = fresh(df, "_packed_cell")
    rows = df.withColumn(cell_, F.col(cell)).drop(pos, val)
    listed_ = fresh(rows, "_values")
    distinct = rows.select(F.col(cell_).alias("cell")).where(F.length(F.regexp_replace("cell", r"(?U)\s+", "")) > 0).distinct()
    cells = cut(spread(distinct, "cell"))
    given = None
    if extra_values is not None:
        given = extra_values.select(F.col(extra_values.columns[0]).alias("key")).where("key <> ''").distinct().withColumn("n", F.lit(2.0))
    votes = cut(_counted(cells, lambda b: (v for c in b["cell"] for v in _votes(c)), given).where("n >= 1"))
    source, one = _prepared(cells, votes, max_broadcast)
    recount = cut(_counted(source, lambda b: ((key_of(v), 1.0) for vs in one(b) for v in vs), given))
    source, two = _prepared(cells, recount, max_broadcast)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({cell_: b["cell"], listed_: two(b)})

    done = source.mapInPandas(listed, f"`{cell_}` string, `{listed_}` array<string>")
    out = rows.join(done, cell_)
    own = [c for c in rows.columns if c != cell_]
    place = fresh(out, "_place")
    out = out.select(*[F.col(f"`{c}`") for c in own], F.posexplode(listed_).alias(place, val))
    return out.withColumn(pos, (F.col(place) + 1).cast("int")).drop(place)
