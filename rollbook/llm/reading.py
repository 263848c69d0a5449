"""Reading level of documents: regularised ordinal regression over readability features.

Features of a whole text, in three groups: the document (lexical diversity, length), its words (rarity against the corpus,
length, connectives) and its sentences (length, commas and subordinating words as a proxy of clause depth), the latter as medians
and quartiles over sentences too, so that a few quoted or list sentences do not set the level. Rarity comes from the counts of all
words of all documents. The frequent words are held by every task, as many as `max_words` allows: those from a count on that is
told from the numbers of words of each count. All rarer words share the rarity of their mean count. A cumulative logit with ridge
penalty, common weights and language deviations is fitted to the graded documents until its loss settles; its cuts and the
steepness of its scores are then calibrated on graded documents that the fit they are scored by has not seen.

Cases: null, blank and wordless texts have zero features and get the level of their features like any other; the language is
judged by function words, not by the `lang` column, and texts with hardly any of them get no deviation; labels outside 1..levels or without text are left out of the fit; with no
labels at all the middle level is given.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.session import cut

#: Words whose own rarity is held by each task (about 30 bytes each); all rarer ones share one.
MAX_WORDS_HELD = 200_000
MAX_LABELS = 30_000
LEVELS = 5
LANGS = ("en", "de", "fr")
#: Share of function words of a language below which a text is in none of them.
LEAST_FUNCTION_WORDS = 0.05

# Function words that tell the languages apart, connectives, subordinating words.
FUNCTION_WORDS = {
    "en": "the of and to in was for with that his her he she it on by as at is were from which this had not",
    "de": "der die das und zu den von mit im dem des ist nicht ein eine einer sie er als auf für wurde wird dass bei nach",
    "fr": "le la les de des du et à un une dans il elle qui que pour au aux en par est sur pas avec ses son sa",
}
CONNECTIVES = "because but so then later after before while when although though however therefore moreover furthermore nevertheless notwithstanding whereas hence thereby consequently accordingly insofar inasmuch albeit provided together following weil aber dann später nachdem bevor während als obwohl jedoch daher außerdem dennoch ungeachtet sofern soweit mangels folglich somit wenngleich gleichwohl hinsichtlich parce mais alors puis ensuite après avant pendant quand quoique cependant donc toutefois néanmoins nonobstant tandis ainsi dès lors corrélativement eu égard conformément afin lorsque"
SUBORDINATORS = "that which who whom whose where if whether since unless until because although while when as dass die der das welche welcher welches wenn ob weil obwohl damit soweit sofern indem que qui dont où si lorsque puisque quoique afin laquelle lequel lesquels"

_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|[.!?]+(?=[\s\])\"»”]|$)|\n|[,;:()]|\d+")
_CITE = re.compile(r"\[\d+\]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\n(?=[^\W\d_A-Z])")
_END, _BREAK, _COMMA, _NUMBER = 0, 1, 2, 3
_SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_CONN, _SUB = frozenset(CONNECTIVES.split()), frozenset(SUBORDINATORS.split())


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "[" in text:
        text = _CITE.sub("", text)
    if "-\n" in text:
        text = _BROKEN.sub("", text)
    return _TOKEN.findall(text)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n): occurrences of lower-cased words over all texts. Counted per task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for t in batch[text]:
                total.update(tokens(t))
            if len(total) > 500_000:
                yield _lowered(total)
                total.clear()
        if total:  # an empty string column has no Arrow array
            yield _lowered(total)

    return df.select(text).mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _lowered(total: Counter[str]) -> pd.DataFrame:
    low: Counter[str] = Counter()
    for w, n in total.items():
        if w[0].isalpha():
            low[w.lower()] += n
    return pd.DataFrame({"word": pd.Series(list(low), dtype="str"), "n": pd.Series(list(low.values()), dtype="int64")})


class Rarity:
    """Negative log frequency of words: their own where they are held, one shared by all others."""

    def __init__(self, counts: dict[str, int], total: float, rest: float) -> None:
        self.total, self.rest = max(total, 1.0), float(np.log(max(total, 1.0) / max(rest, 1.0)))
        self.own = {w: float(np.log(self.total / n)) for w, n in counts.items()}

    def of(self, word: str) -> float:
        return self.own.get(word, self.rest)


def rarity_table(counts: DataFrame, max_words: int = MAX_WORDS_HELD) -> Rarity:
    """The rarity of words from (word, n); at most max_words of them come to the driver.

    The least count held is told from the number of words of each count, of which there are few: the words of a corpus of N tokens
    have less than sqrt(2 N) different counts.
    """
    counts = cut(counts)
    of_count = sorted(((r[0], r[1]) for r in counts.groupBy("n").count().collect()), reverse=True)
    held, least = 0, 0
    for n, words in of_count:
        if held + words > max_words:
            break
        held, least = held + words, n
    rest = [(n, words) for n, words in of_count if held == 0 or n < least]
    rows = counts.where(F.col("n") >= least).toPandas() if held else pd.DataFrame({"word": [], "n": []})
    mean = sum(n * k for n, k in rest) / max(1, sum(k for _, k in rest))
    return Rarity(dict(zip(rows["word"], rows["n"].astype(float))), float(sum(n * k for n, k in of_count)), mean)


class Lexicon:
    """Numeric attributes of words, computed once per word and worker."""

    def __init__(self, rarity: Rarity) -> None:
        self.rarity = rarity
        self.ids: dict[str, int] = {}
        # Columns: kind (0 end, 1 break, 2 comma, 3 number, 4 word), length, rarity, connective, subordinator, en, de, fr, capital.
        self.table = np.zeros((1024, 9), dtype=np.float32)

    def __len__(self) -> int:
        return len(self.ids)

    def id_of(self, token: str) -> int:
        c = token[0]
        if c in ".!?":
            row = (_END, 0, 0, 0, 0, 0, 0, 0, 0)
        elif c == "\n":
            row = (_BREAK, 0, 0, 0, 0, 0, 0, 0, 0)
        elif c.isdigit():
            row = (_NUMBER, 0, 0, 0, 0, 0, 0, 0, 0)
        elif not c.isalpha():
            row = (_COMMA, 0, 0, 0, 0, 0, 0, 0, 0)
        else:
            w = token.lower()
            row = (4, len(w), self.rarity.of(w), w in _CONN, w in _SUB, w in _SETS["en"], w in _SETS["de"], w in _SETS["fr"], c.isupper())
        k = len(self.ids)
        if k == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[k] = row
        self.ids[token] = k
        return k

    def encode(self, toks: list[str]) -> np.ndarray:
        ids = self.ids
        try:
            out = [ids[t] for t in toks]
        except KeyError:
            out = [ids[t] if t in ids else self.id_of(t) for t in toks]
        return np.array(out, dtype=np.int32)

    def attributes(self, codes: np.ndarray) -> np.ndarray:
        return self.table[codes]


FEATURES = (
    "bias_len", "root_ttr", "mean_len", "long7", "long10", "long13", "rarity", "rare_share", "rare_high", "connective", "commas",
    "sub", "sent_mean", "sent_q25", "sent_q50", "sent_q75", "slen_q25", "slen_q50", "slen_q75", "srar_q25", "srar_q50", "srar_q75", "scom_q50", "ssub_q50", "slong_q50", "capital",
)
N_FEATURES = len(FEATURES)


def _quantiles(value: np.ndarray, doc: np.ndarray, n_docs: int, qs: tuple[float, ...]) -> list[np.ndarray]:
    """Linear-interpolated quantiles of the values of each document; 0 for documents without any. doc is ascending."""
    order = np.lexsort((value, doc))
    v = value[order]
    n = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n) - n
    out = []
    for q in qs:
        at = q * np.maximum(n - 1, 0)
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, np.maximum(n - 1, 0))
        picked = np.zeros(n_docs)
        some = n > 0
        a, b = v[(first + low)[some]], v[(first + high)[some]]
        picked[some] = a + (b - a) * (at - low)[some]
        out.append(picked)
    return out


def features(docs: list[list[str]], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and language of a batch of token lists."""
    n_docs = len(docs)
    out = np.zeros((n_docs, N_FEATURES))
    lang = np.full(n_docs, len(LANGS), dtype=np.int64)
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    if not sizes.sum():
        return out, lang
    codes = lexicon.encode([t for d in docs for t in d])
    doc = np.repeat(np.arange(n_docs), sizes)
    a = lexicon.attributes(codes)
    kind = a[:, 0]
    word = kind == 4
    if not word.any():
        return out, lang
    opens = kind <= _BREAK
    opens[np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]] = True
    sentence = np.cumsum(opens)
    w, wd, s = a[word], doc[word], sentence[word]
    per = lambda x, at=wd: np.bincount(at, weights=x, minlength=n_docs)
    n = np.bincount(wd, minlength=n_docs)
    some = np.maximum(n, 1)
    known = np.stack([per(w[:, k]) for k in (5, 6, 7)], axis=1)
    lang = np.where(known.max(axis=1) >= LEAST_FUNCTION_WORDS * some, known.argmax(axis=1), len(LANGS))
    length, rar = w[:, 1], w[:, 2]
    own = w[:, 8] == 0  # names are no measure of difficulty
    own_per = per(own)
    use = own | (own_per == 0)[wd]
    m = np.maximum(per(use), 1)
    out[:, 0] = np.where(n > 0, np.log(some), 0)
    pairs = np.unique(wd * np.int64(len(lexicon)) + codes[word])
    out[:, 1] = np.bincount(pairs // len(lexicon), minlength=n_docs) / np.sqrt(some)
    out[:, 2] = per(length * use) / m
    for k, least in ((3, 7), (4, 10), (5, 13)):
        out[:, k] = per((length >= least) & use) / m
    out[:, 6] = per(rar * use) / m
    out[:, 7], out[:, 8] = per((rar > 6) & use) / m, per((rar > 8) & use) / m
    out[:, 9] = per(w[:, 3]) / some
    # Sentences end at full stops and line breaks.
    starts = np.flatnonzero(np.diff(s, prepend=-1))
    counts = np.diff(np.append(starts, len(s)))
    s_doc, s_id = wd[starts], s[starts]
    commas = np.zeros(len(starts))
    comma_at = np.searchsorted(s_id, sentence[kind == _COMMA], side="right") - 1
    same = (comma_at >= 0) & (s_doc[comma_at.clip(0)] == doc[kind == _COMMA])
    np.add.at(commas, comma_at[same], 1)
    total = lambda x: np.add.reduceat(x.astype(np.float64), starts)
    own_n = np.maximum(1, total(own))
    s_len, s_rar, s_long, s_sub = total(length * own) / own_n, total(rar * own) / own_n, total((length >= 10) & own) / own_n, total(w[:, 4])
    keep = counts >= 2
    keep |= ~np.bincount(s_doc[keep], minlength=n_docs).astype(bool)[s_doc]
    kd = s_doc[keep]
    k_n = np.maximum(np.bincount(kd, minlength=n_docs), 1)
    mean = lambda x: np.bincount(kd, weights=x[keep], minlength=n_docs) / k_n
    out[:, 10], out[:, 11], out[:, 12] = mean(commas), mean(s_sub), mean(counts)
    at = 13
    for values, qs in ((counts, (0.25, 0.5, 0.75)), (s_len, (0.25, 0.5, 0.75)), (s_rar, (0.25, 0.5, 0.75)), (commas, (0.5,)), (s_sub, (0.5,)), (s_long, (0.5,))):
        for column in _quantiles(values[keep].astype(np.float64), kd, n_docs, qs):
            out[:, at] = column
            at += 1
    out[:, 25] = per(w[:, 8]) / some
    return out, lang


def _logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _descend(params: list[np.ndarray], loss_and_gradients: Callable[[], tuple[float, list[np.ndarray]]], tolerance: float = 1e-5) -> None:
    """Adam in stretches of 50 steps; a stretch that gains too little divides the rate by 3, and the third such one ends it."""
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rate, step, before = 0.1, 0, np.inf
    while rate > 0.1 / 27:
        for _ in range(50):
            step += 1
            loss, gradients = loss_and_gradients()
            for value, grad, m1, m2 in zip(params, gradients, first, second):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                value -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        if before - loss < tolerance * max(1.0, abs(loss)):
            rate /= 3
        before = min(before, loss)


def _slopes(score: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of a cumulative logit: negative log likelihood, its slope by score, its slope by cut."""
    bounds = np.concatenate([[-np.inf], np.sort(cuts), [np.inf]])
    up, low = _logistic(bounds[y] - score), _logistic(bounds[y - 1] - score)
    p = np.maximum(up - low, 1e-9)
    d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
    return float(-np.log(p).sum()), d_up - d_low, np.array([d_low[y == k + 1].sum() - d_up[y == k].sum() for k in range(1, len(cuts) + 1)])


class OrdinalModel:
    """Cumulative logit: common weights, language deviations and offsets, ridge penalties; fitted on all rows at once."""

    def __init__(self, ridge: float = 2.0, ridge_lang: float = 8.0, levels: int = LEVELS, folds: int = 3) -> None:
        self.ridge, self.ridge_lang, self.levels, self.folds = ridge, ridge_lang, levels, folds

    def fit(self, x: np.ndarray, lang: np.ndarray, y: np.ndarray) -> OrdinalModel:
        """Fit, then calibrate on the rows scored by fits of the other folds."""
        unseen = np.zeros(len(y))
        folds = np.arange(len(y)) % self.folds
        calibrated = len(y) >= 20 * self.levels
        for k in range(self.folds if calibrated else 0):
            unseen[folds == k] = OrdinalModel(self.ridge, self.ridge_lang, self.levels)._fitted(x[folds != k], lang[folds != k], y[folds != k]).score(x[folds == k], lang[folds == k])
        self._fitted(x, lang, y)
        if calibrated:
            # In units of the unseen scores' spread, starting where the shares of the levels put the cuts.
            spread = unseen.std() + 1e-9
            unit, slope = unseen / spread, np.ones(1)
            cuts = np.quantile(unit, [np.mean(y <= k) for k in range(1, self.levels)])

            def gradients() -> tuple[float, list[np.ndarray]]:
                loss, by_score, by_cut = _slopes(slope[0] * unit, y, cuts)
                return loss / len(y), [np.array([(by_score * unit).sum() / len(y)]), by_cut / len(y)]

            _descend([slope, cuts], gradients)
            if slope[0] > 0:
                self.cuts = np.sort(cuts) / slope[0] * spread
        return self

    def _fitted(self, x: np.ndarray, lang: np.ndarray, y: np.ndarray) -> OrdinalModel:
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        z, n, n_lang = self._expanded(x), len(y), len(LANGS)
        # The last row of weights and offset, of no language, stays zero.
        weights, cuts, offset = np.zeros((2 + n_lang, z.shape[1])), np.linspace(-2, 2, self.levels - 1), np.zeros(1 + n_lang)
        groups = [np.flatnonzero(lang == k) for k in range(n_lang)]

        def gradients() -> tuple[float, list[np.ndarray]]:
            score = (z * (weights[0] + weights[1:][lang])).sum(axis=1) + offset[lang]
            loss, g, g_cuts = _slopes(score, y, cuts)
            loss += 0.5 * (self.ridge * ((weights[0] ** 2).sum() + (offset**2).sum()) + self.ridge_lang * (weights[1:] ** 2).sum())
            g_w = np.vstack([z.T @ g + self.ridge * weights[0], *[z[at].T @ g[at] + self.ridge_lang * weights[1 + k] for k, at in enumerate(groups)], np.zeros(z.shape[1])])
            g_off = np.array([*(g[at].sum() for at in groups), 0.0]) + self.ridge * offset
            return loss / n, [g_w / n, g_cuts / n, g_off / n]

        _descend([weights, cuts, offset], gradients)
        self.weights, self.cuts, self.offset = weights, np.sort(cuts), offset
        return self

    def score(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return (self._expanded(x) * (self.weights[0] + self.weights[1:][lang])).sum(axis=1) + self.offset[lang]

    def _expanded(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, clipped at four deviations, and their squares."""
        z = np.clip((x - self.mean) / self.sd, -4, 4)
        return np.hstack([z, z * z - 1])

    def predict(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return 1 + (self.score(x, lang)[:, None] > self.cuts[None]).sum(axis=1)


#: Words a worker remembers; its lexicon then starts anew.
MAX_WORDS = 300_000
_LEXICON: list[tuple] = []


def _lexicon(rarity: Rarity) -> Lexicon:
    if not _LEXICON or _LEXICON[0][0] is not rarity or len(_LEXICON[0][1]) > MAX_WORDS:
        _LEXICON[:] = [(rarity, Lexicon(rarity))]
    return _LEXICON[0][1]


#: Documents whose tokens are held at once.
BATCH_DOCS = 1_000


def _in_batches(texts: pd.Series, rarity: Rarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(texts), BATCH_DOCS):
        docs = [tokens(t) for t in texts.iloc[at : at + BATCH_DOCS]]
        x, lang = features(docs, _lexicon(rarity))
        yield x, lang


def reading_level(df: DataFrame, text: str, doc_id: str, labels: DataFrame, out: str = "reading_level", max_labels: int = MAX_LABELS, max_words: int = MAX_WORDS_HELD) -> DataFrame:
    """df with the reading level of each text, judged by a model fitted to labels (doc_id, reading_level).

    max_labels: of more labelled documents than this, those with the smallest hashed ids are used for the fit; nothing else is bounded.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(rarity_table(word_counts(df, text), max_words))

    def measured(texts: pd.Series) -> pd.DataFrame:
        parts = list(_in_batches(texts, shared.value))
        x = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, N_FEATURES))
        lang = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"x": list(x), "lang": lang.astype("int32")})

    graded = labels.where(F.col("reading_level").between(1, LEVELS)).select(F.col(doc_id), F.col("reading_level").cast("int").alias("_y"))
    if graded.count() > max_labels:
        graded = graded.orderBy(F.xxhash64(doc_id), doc_id).limit(max_labels)
    known = df.select(doc_id, F.col(text).alias("_t")).where("_t is not null").join(F.broadcast(graded), doc_id)
    rows = known.select("_y", F.pandas_udf(measured, "x array<double>, lang int")("_t").alias("_f")).select("_y", "_f.x", "_f.lang").toPandas()
    if len(rows):
        rows = rows.sort_values(["_y", "lang"], kind="stable")
        model = OrdinalModel().fit(np.array(rows["x"].tolist()), rows["lang"].to_numpy(), rows["_y"].to_numpy())
    else:
        model = None
    fitted = spark.sparkContext.broadcast(model)

    def judge(texts: pd.Series) -> pd.Series:
        if fitted.value is None:
            return pd.Series(np.full(len(texts), (LEVELS + 1) // 2), dtype="int32")
        levels = [fitted.value.predict(x, lang) for x, lang in _in_batches(texts, shared.value)]
        return pd.Series(np.concatenate(levels) if levels else np.zeros(0), dtype="int32")

    return df.withColumn(out, F.pandas_udf(judge, "int")(F.col(text)))
