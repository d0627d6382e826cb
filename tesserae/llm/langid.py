"""Language identification by unigrams over pieces, summed over all segmentations.

A language is a probability for each piece of a fixed public vocabulary. A word (a run of letters in lower case,
behind the vocabulary's mark of a word's start) has the probability of all its segmentations into pieces together,
which a forward pass adds up; characters without a piece count as one unknown piece. A text's
log-probability is the sum over its words, its language the one with the greatest.

Piece probabilities are fitted by expectation-maximisation: the forward and backward passes give the expected
count of each piece. Labelled rows beyond `per_language` (expected) in a language are left out of the fit by a hash
of doc_id and text; all texts are predicted, whole. Only text and lang of rows that are not held out are learned from.

Defined results: a null text, or one without letters, is `und` with score 0; without labelled rows all
texts are. Rows without doc_id are told apart by their text in the sample. Equal probabilities go to the language first in order. A null doc_id is not held out. More than
MOST_LANGUAGES different values of lang raise an error, since the model is kept in memory. Repeated rows each give
a row. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ship, unused, written

LETTERS = re.compile(r"[^\W\d_]+")
PER_LANGUAGE = 2000
ROUNDS = 2
MOST_LANGUAGES = 200
#: What a text must reach to be accepted; see accepted().
LEAST_SCORE, LETTERS_LEAST, LEAST_FIT = 0.5, 40, 0.45
#: A word fits a language if its log-probability a sign isn't below FIT times the language's mean.
FIT = 2.0
#: Words whose scores a worker keeps.
CACHE = 150_000
CELLS = 150_000


def words(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces but for control signs, the unknown piece and bytes."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return sorted({p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))} - {""})


class Lattice:
    """Finds the pieces of many words at once, by hashes of substrings in an open table."""

    def __init__(self, vocabulary: list[str]):
        import numpy as np

        self.n = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        self.bits = 18
        while True:  # a table in which no two pieces meet in more than two places
            slots = np.full((1 << self.bits) + 8, 0, np.uint64)
            ids = np.full((1 << self.bits) + 8, -1, np.int32)
            if self._put(vocabulary, slots, ids):
                break
            self.bits += 1
        self.slots, self.ids = slots, ids

    STEP, MUL = 0x100000001B3, 0x9E3779B97F4A7C15

    def _put(self, vocabulary, slots, ids) -> bool:  # noqa: ANN001
        for i, v in enumerate(vocabulary):
            h = 0
            for c in v:
                h = (h * self.STEP + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            at = ((h * self.MUL) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            for k in range(4):
                if ids[at + k] < 0:
                    slots[at + k], ids[at + k] = h, i
                    break
            else:
                return False
        return True

    def find(self, h):  # noqa: ANN001, ANN201
        """The pieces with these hashes; -1: none."""
        import numpy as np

        at = ((h * np.uint64(self.MUL)) >> np.uint64(64 - self.bits)).astype(np.int64)
        ids = np.full(h.shape, -1, np.int32)
        for probe in range(4):
            hit = self.slots[at + probe] == h
            ids[hit] = self.ids[at + probe][hit]
        return ids

    def edges(self, chars):  # noqa: ANN001, ANN201
        """For a matrix of character codes (words of one padded length; 0: padding): ids[k][:, j] of the piece from j to j + k + 1.

        -1: none. A single character without a piece has the id n.
        """
        import numpy as np

        h = np.zeros(chars.shape, np.uint64)
        out = []
        width = chars.shape[1]
        for k in range(min(self.longest, width)):
            cells = width - k
            h = h[:, :cells] * np.uint64(self.STEP) + chars[:, k:].astype(np.uint64) + np.uint64(1)
            ids = self.find(h)
            ids[chars[:, k:] == 0] = -1
            if k == 0:
                ids[(ids < 0) & (chars != 0)] = self.n
            out.append(ids)
        return out


def _matrix(batch: list[str]):  # noqa: ANN202
    import numpy as np

    width = max(map(len, batch))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(batch), width)


def _chunks(batch: list[str]) -> Iterator[list[int]]:
    order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(batch[order[hi]]) <= CELLS and len(batch[order[hi]]) <= 2 * len(batch[order[lo]]) + 4:
            hi += 1
        yield order[lo:hi]
        lo = hi


def forward(lattice: Lattice, prob, batch: list[str]):  # noqa: ANN001, ANN201
    """log-probability of each word under each language: the sum over all segmentations. prob: (n + 2) x languages, last row 0."""
    import numpy as np

    out = np.zeros((len(batch), prob.shape[1]))
    for part in _chunks(batch):
        marked = ["▁" + batch[i] for i in part]
        chars = _matrix(marked)
        ids = lattice.edges(chars)
        n, width = chars.shape
        ends = np.array([len(w) for w in marked])
        scale = np.zeros((n, prob.shape[1]))
        last = [np.ones((n, prob.shape[1]))]  # sums at the positions before, nearest first
        for i in range(1, width + 1):
            acc = np.zeros((n, prob.shape[1]))
            for k in range(min(len(ids), i)):
                col = ids[k][:, i - k - 1]
                if (col >= 0).any():
                    acc += last[k] * prob[col]
            last = [acc, *last[: lattice.longest - 1]]
            if i % 8 == 0:  # against underflow
                top = np.maximum.reduce(last)
                top[top <= 0] = 1.0
                scale += np.log(top)
                last = [x / top for x in last]
            done = ends == i
            if done.any():
                out[np.array(part)[done]] = np.log(np.maximum(last[0][done], 1e-300)) + scale[done]
    return out


def expected(lattice: Lattice, p, batch: list[str], counts):  # noqa: ANN001, ANN201
    """Expected counts of the pieces in words with their counts, under one language's p (n + 2, last 0)."""
    import numpy as np

    total = np.zeros(lattice.n + 1)
    for part in _chunks(batch):
        marked = ["▁" + batch[i] for i in part]
        chars = _matrix(marked)
        ids = lattice.edges(chars)
        n, width = chars.shape
        ends = np.array([len(w) for w in marked])
        up, down = np.zeros((n, width + 1)), np.zeros((n, width + 1))
        up_scale, down_scale = np.zeros_like(up), np.zeros_like(down)  # logarithms

        def scaled(sums, scale, lo, hi) -> None:  # noqa: ANN001
            """Brings the columns that later ones need to a greatest sum of 1, against underflow."""
            top = sums[:, lo:hi].max(axis=1)
            top[top <= 0] = 1.0
            sums[:, lo:hi] /= top[:, None]
            scale[:, lo:hi] += np.log(top)[:, None]

        up[:, 0] = 1
        for i in range(1, width + 1):
            up_scale[:, i] = up_scale[:, i - 1]
            for k in range(min(len(ids), i)):
                up[:, i] += up[:, i - k - 1] * p[ids[k][:, i - k - 1]]
            if i % 8 == 0:
                scaled(up, up_scale, max(0, i - lattice.longest + 1), i + 1)
        down[np.arange(n), ends] = 1
        for j in range(width - 1, -1, -1):
            down_scale[:, j] = down_scale[:, j + 1]
            for k in range(min(len(ids), width - j)):
                down[:, j] += down[:, j + k + 1] * p[ids[k][:, j]]
            if j % 8 == 0:
                scaled(down, down_scale, j, min(width, j + lattice.longest - 1) + 1)
        of_word = np.log(np.maximum(up[np.arange(n), ends], 1e-300)) + up_scale[np.arange(n), ends]
        for k, col in enumerate(ids):
            cells = width - k
            scale = np.exp(np.minimum(up_scale[:, :cells] + down_scale[:, k + 1 :] - of_word[:, None], 700))
            share = up[:, :cells] * p[col] * down[:, k + 1 :] * scale * np.asarray(counts, float)[part][:, None]
            total += np.bincount(np.where(col < 0, lattice.n + 1, col).ravel(), share.ravel(), lattice.n + 2)[:-1]
    return total


def held_out(doc_id) -> F.Column:  # noqa: ANN001
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(docs: DataFrame, path: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS):  # noqa: ANN201
    """(languages, probabilities as (pieces + 2) x languages, mean log-probability a sign by language) from doc_id, text, lang of rows that are not held out."""
    import numpy as np
    import pyarrow as pa

    ship(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    langs = sorted(sizes)
    vocabulary = pieces(path)
    n = len(vocabulary)
    if not langs:
        return [], np.zeros((n + 2, 0)), np.zeros(0)
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))]), F.col("lang"))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for w, c in Counter(words(t.as_py())).items():
                    seen[lang, w] += c
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    counted = written(sample.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    p = np.full((n + 2, len(langs)), 1.0 / (n + 1))
    p[-1] = 0
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(p)

        def step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            lattice = _lattice(path)
            sums = np.zeros((n + 1, len(langs)))
            for b in batches:
                of, ws, ns = (b.column(i).to_pylist() for i in range(3))
                for k, lang in enumerate(langs):
                    mine = [i for i, x in enumerate(of) if x == lang]
                    if mine:
                        sums[:, k] += expected(lattice, held.value[:, k], [ws[i] for i in mine], [ns[i] for i in mine])
            piece, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[piece, k], pa.float64())], names=["k", "piece", "c"])

        rows = counted.mapInArrow(step, "k int, piece int, c double").groupBy("k", "piece").agg(F.sum("c").alias("c")).toPandas()
        c = np.zeros((n + 1, len(langs)))
        c[rows.piece.to_numpy(), rows.k.to_numpy()] = rows.c.to_numpy()
        # smoothed towards all languages together, and those towards all pieces alike
        every = (c.sum(axis=1) + 1.0 / (n + 1)) / (c.sum() + 1)
        p = np.vstack([(c + 100 * every[:, None]) / (c.sum(axis=0) + 100), np.zeros((1, len(langs)))])
    last = docs.sparkSession.sparkContext.broadcast(p)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path)
        for b in batches:
            k = np.array([langs.index(x) for x in b.column(0).to_pylist()])
            ws, ns = b.column(1).to_pylist(), b.column(2).to_numpy()
            logs = forward(lattice, last.value, ws)[np.arange(len(k)), k]
            signs = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs)), pa.int32()), pa.array(np.bincount(k, ns * logs, len(langs))), pa.array(np.bincount(k, ns * signs, len(langs)))], names=["k", "log", "signs"])

    sums = {r.k: r.log / r.signs for r in counted.mapInArrow(rates, "k int, log double, signs double").groupBy("k").agg(F.sum("log").alias("log"), F.sum("signs").alias("signs")).collect() if r.signs}
    return langs, p, np.array([sums.get(k, 0.0) for k in range(len(langs))])


_lattices: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(pieces(path))
    return _lattices[path]


def accepted(docs: DataFrame, path: str, languages: list[str] | None = None, least_score: float = LEAST_SCORE, least_fit: float = LEAST_FIT) -> DataFrame:
    """docs whose text is in one of the languages (None: all that are learned); columns stay as they are.

    A text goes if it has no letters, if another language is predicted, if the prediction's score is under least_score, or
    if it has LETTERS_LEAST letters or more and less than the share least_fit of them stands in words that fit the
    predicted language: then no language fits it, although one fits it best. Shorter texts are too short to tell.
    """
    names = unused(docs.columns, "lang_pred", "score", "letters", "fit")
    lang, score, letters, fits = map(F.col, names)
    found = predicted(docs, path, fit(docs, path), names=names[:2], fit_names=names[2:])
    keep = (lang != "und") & (score >= least_score) & ((letters < LETTERS_LEAST) | (fits >= least_fit))
    return found.filter(keep if languages is None else keep & lang.isin(languages)).drop(*names)


class Scorer:
    """Scores of words by language, kept for the words seen last."""

    def __init__(self, path: str, prob, rate):  # noqa: ANN001
        import numpy as np

        self.lattice, self.prob, self.rate = _lattice(path), prob, rate
        self.at: dict[str, int] = {}
        self.rows = np.zeros((CACHE, prob.shape[1]))
        self.fits = np.zeros((CACHE, prob.shape[1]), np.int32)

    def texts(self, batch: list[list[str]]):  # noqa: ANN201
        """The log-probability of each list of words, and how many letters stand in words that fit, both by language."""
        import numpy as np

        out, fits = np.zeros((len(batch), self.prob.shape[1])), np.zeros((len(batch), self.prob.shape[1]))
        for i, ws in enumerate(batch):
            for lo in range(0, len(ws), CACHE // 4):
                part = ws[lo : lo + CACHE // 4]
                if len(self.at) + len(part) > CACHE:
                    self.at.clear()
                self._add([w for w in dict.fromkeys(part) if w not in self.at])
                at = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
                out[i] += self.rows[at].sum(axis=0)
                fits[i] += self.fits[at].sum(axis=0)
        return out, fits

    def _add(self, new: list[str]) -> None:
        import numpy as np

        if new:
            first = len(self.at)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            rows = self.rows[first : first + len(new)] = forward(self.lattice, self.prob, new)
            sizes = np.fromiter(map(len, new), np.int64, len(new))[:, None]
            self.fits[first : first + len(new)] = np.where(rows >= FIT * self.rate * (sizes + 1), sizes, 0)

    def prepare(self, batch: list[list[str]]) -> None:
        """Scores the new words of many texts together."""
        new = list(dict.fromkeys(w for ws in batch for w in ws if w not in self.at))
        if len(self.at) + len(new) > CACHE:
            self.at.clear()
            new = list(dict.fromkeys(w for ws in batch for w in ws))
        if len(new) <= CACHE // 2:
            self._add(new)


def predicted(docs: DataFrame, path: str, model: tuple | None = None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"), fit_names: tuple[str, str] | None = None) -> DataFrame:
    """docs with lang_pred string and score double (the posterior, all languages alike before) by these names; columns of docs so named are replaced. No shuffle.

    fit_names: also the number of letters, long, and the share of them that stands in words that fit the predicted language
    (null without letters), double.
    """
    import numpy as np
    import pyarrow as pa

    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, path))
    new = [*names, *(fit_names or ())]
    rest = [c for c in docs.columns if c not in new]
    src = docs.select(*[f"`{c}`" for c in rest])
    at = rest.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema] + [f"`{n}` {k}" for n, k in zip(new, ("string", "double", "bigint", "double"), strict=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob, rate = held.value
        scorer = Scorer(path, prob, rate)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = [words(t.as_py()) if langs else [] for t in part.column(at)]
                pred, score, sizes, share = ["und"] * len(lists), [0.0] * len(lists), [sum(map(len, ws)) for ws in lists], [None] * len(lists)
                if langs:
                    scorer.prepare(lists)
                    logs, fits = scorer.texts(lists)
                    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                    odds /= odds.sum(axis=1, keepdims=True)
                    for i, k in enumerate(odds.argmax(axis=1)):
                        if lists[i]:
                            pred[i], score[i], share[i] = langs[k], float(odds[i, k]), float(fits[i, k]) / sizes[i]
                more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sizes, pa.int64()), pa.array(share, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more[: len(new)]], names=[*rest, *new])

    return src.mapInArrow(run, schema)


def identified(docs: DataFrame, path: str) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score."""
    return predicted(docs.select("doc_id", "text"), path, fit(docs, path)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
