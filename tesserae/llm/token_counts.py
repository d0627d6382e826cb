"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a run of characters that aren't white space, behind the vocabulary's mark of a word's start. The
vocabulary is public and fixed; the piece of rank r (from 0) has the probability 1 / (r + 2) over the sum of all, and a
character without a piece counts as one piece of the least probability.

The distinct new pre-tokens of a batch are put into a trie. Its nodes are handled level by level, each once for all
pre-tokens that share it: the forward score (log-probability of all segmentations of the prefix together), the score
of the best segmentation and its number of pieces follow from the nodes up to the longest piece's length above. The
node where a pre-token ends stores its counts, and a document adds up those of its pre-tokens.

Defined results: a null or blank text has 0 pre-tokens, 0 tokens and log_prob 0; among equally good segmentations the
one with fewer pieces counts. Repeated rows each give a row. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose counts a worker keeps, and characters in a trie's matrix at most (a longer pre-token stands alone).
CACHE = 500_000
CELLS = 1_000_000


class Unigram:
    """A vocabulary of pieces with log-probabilities, and counts by trie."""

    def __init__(self, pieces: list[str]):
        import numpy as np

        from tesserae.llm.langid import Lattice

        self.table = Lattice(pieces)
        weight = 1.0 / (np.arange(len(pieces)) + 2.0)
        #: Last but one: a character without a piece; last: no piece.
        self.logp = np.concatenate([np.log(weight / weight.sum()), [np.log(weight[-1] / weight.sum()), -np.inf]])

    def counts(self, words: list[str]):  # noqa: ANN201
        """(pieces of the best segmentation, log-probability of all segmentations) of each distinct word."""
        import numpy as np

        n, logs = np.zeros(len(words), np.int64), np.zeros(len(words))
        order = sorted(range(len(words)), key=words.__getitem__)
        lo = 0
        while lo < len(order):
            hi, width = lo, 0
            while hi < len(order) and (hi == lo or (hi - lo + 1) * max(width, len(words[order[hi]])) <= CELLS):
                width = max(width, len(words[order[hi]]))
                hi += 1
            part = order[lo:hi]
            n[part], logs[part] = self._trie([words[i] for i in part])
            lo = hi
        return n, logs

    def _trie(self, words: list[str]):  # noqa: ANN202
        """For sorted words."""
        import numpy as np

        t = self.table
        marked = ["▁" + w for w in words]
        lengths = np.array([len(w) for w in marked])
        width = int(lengths.max())
        chars = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
        fresh = np.zeros(len(words), bool)  # whether a word leaves the one before it above this level
        fresh[0] = True
        # per level, nearest first: the nodes' forward scores, best scores, pieces of the best, hashes of what ends there, parents
        up = [(np.zeros(1), np.zeros(1), np.zeros(1, np.int64))]
        hashes: list = []
        parents: list = []
        rows = np.arange(len(words))
        at = np.zeros(len(words), np.int64)  # each living word's node on the level above
        n, logs = np.zeros(len(words), np.int64), np.zeros(len(words))
        for depth in range(width):
            alive = lengths[rows] > depth
            # a word that ended above parts nothing: the next one that lives keeps what it has in common with the last that lived
            if not alive.all():
                starts = np.concatenate([[0], np.cumsum(alive)[:-1]])
                carried = np.zeros(int(alive.sum()) + 1, bool)
                np.logical_or.at(carried, starts, fresh)
                rows, at, fresh = rows[alive], at[alive], carried[:-1]
            if not len(rows):
                break
            c = chars[rows, depth]
            fresh = fresh.copy()
            fresh[1:] |= c[1:] != c[:-1]
            node = np.cumsum(fresh) - 1
            parent, code = at[fresh], c[fresh].astype(np.uint64)
            forward = np.full(len(parent), -np.inf)
            best = np.full(len(parent), -np.inf)
            pieces = np.zeros(len(parent), np.int64)
            above, mine = parent, []
            for k in range(min(t.longest, depth + 1)):
                h = (hashes[0][k - 1][parent] if k else np.zeros(len(parent), np.uint64)) * np.uint64(t.STEP) + code + np.uint64(1)
                mine.append(h)
                ids = t.find(h)
                if k == 0:
                    ids[ids < 0] = t.n
                lp = self.logp[ids]
                f, b, p = up[k][0][above], up[k][1][above], up[k][2][above]
                forward = np.logaddexp(forward, f + lp)
                score, count = b + lp, p + 1
                better = (score > best) | ((score == best) & (count < pieces))
                best, pieces = np.where(better, score, best), np.where(better, count, pieces)
                if k + 1 < min(t.longest, depth + 1):
                    above = parents[k][above]
            parents = [parent, *parents[: t.longest]]
            up = [(forward, best, pieces), *up[: t.longest - 1]]
            hashes = [mine]
            at = node
            ends = lengths[rows] == depth + 1
            n[rows[ends]], logs[rows[ends]] = pieces[node[ends]], forward[node[ends]]
        return n, logs


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    if path not in _models:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        _models[path] = Unigram([p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))])
    return _models[path]


class Counter:
    """Counts of pre-tokens, kept for those seen last."""

    def __init__(self, unigram: Unigram):
        import numpy as np

        self.unigram = unigram
        self.at: dict[str, int] = {}
        self.n, self.logs = np.zeros(CACHE, np.int64), np.zeros(CACHE)

    def text(self, words: list[str]) -> tuple[int, float]:
        """Tokens and log-probability of a list of pre-tokens."""
        import numpy as np

        n, logs = 0, 0.0
        for lo in range(0, len(words), CACHE // 4):
            part = words[lo : lo + CACHE // 4]
            self.learn([part])
            rows = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            n, logs = n + int(self.n[rows].sum()), logs + float(self.logs[rows].sum())
        return n, logs

    def learn(self, lists: list[list[str]]) -> None:
        new = list(dict.fromkeys(w for ws in lists for w in ws if w not in self.at))
        if len(self.at) + len(new) > CACHE:
            self.at.clear()
            new = list(dict.fromkeys(w for ws in lists for w in ws))
        if new and len(new) <= CACHE:
            lo, hi = len(self.at), len(self.at) + len(new)
            self.n[lo:hi], self.logs[lo:hi] = self.unigram.counts(new)
            self.at.update(zip(new, range(lo, hi), strict=True))


def counted(docs: DataFrame, path: str) -> DataFrame:
    """Per document doc_id, n_pretokens, n_tokens, log_prob. No shuffle."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(model(path))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = [(t.as_py() or "").split() for t in part.column(1)]
                c.learn(lists)
                found = [c.text(ws) for ws in lists]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(ws) for ws in lists], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())],
                    names=["doc_id", "n_pretokens", "n_tokens", "log_prob"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint, log_prob double")
