"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts with one state and a loop for each byte. Each merge (u, v) -> w adds one gadget:

* a new state is a copy of the state that u leads to, without its arc for v; from then on u leads to it;
* every state that has an arc for u gets one for w, leading to where v led before.

After the last merge a token sequence is a path of the automaton exactly if it is the encoding of the bytes
it spells, so each byte string has one path, which encode() finds. A state is kept as (state copied, label
left out, merge number), and its arcs are worked out from that when they are first asked for and then kept in
a transition table; 50,000 merges take 50,000 such rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as in Unicode's property, which the pre-tokenizer's pattern means by its class for space.
WS = "\t-\r \x85\xa0  -     　"
#: Cuts at places where no match of the pre-tokenizer's pattern can go across.
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]")
#: The pre-tokenizer's pattern for texts of Latin characters below U+0250, whose letters and numbers are written out.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_WS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_WS}{LATIN_LETTERS}{LATIN_NUMBERS}]+|[{LATIN_WS}]+(?![^{LATIN_WS}])|[{LATIN_WS}]+")
BEYOND = re.compile("[^\x00-\u024f]")
#: Chunks whose encoding a worker keeps (about 200 bytes each) in each of two tables: a full one becomes the old one.
CACHE = 200_000
ARCS = 1_000_000
#: Bytes by which the longest token at a place is looked up.
HEAD = 6


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """labels: the bytes of each token id; merges: (left id, right id, id of both) in order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.parent, self.without, self.since = [-1], [-1], [-1]
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.to = dict.fromkeys(labels, 0)
        for k, (u, v, w) in enumerate(merges):
            before = self.to[u]
            if not self.has(before, v):
                continue  # an earlier merge keeps u and v apart: the gadget adds no arc
            self.parent.append(before)
            self.without.append(v)
            self.since.append(k)
            self.to[w] = self.to[v]
            self.to[u] = len(self.parent) - 1
            if w not in self.born:
                self.born[w], self.left[w] = k, u
        made = set(self.born) | {t for t, x in labels.items() if len(x) == 1}
        self.ids = {x: t for t, x in labels.items() if t in made}
        #: The greatest length of a token that starts with these HEAD bytes; other places have no token longer than HEAD - 1.
        self.reach: dict[bytes, int] = {}
        for x in self.ids:
            if len(x) >= HEAD:
                self.reach[x[:HEAD]] = max(len(x), self.reach.get(x[:HEAD], 0))
        self.table: list[dict[int, bool] | None] = [None] * len(self.parent)
        self.kept = 0

    def has(self, q: int, t: int) -> bool:
        """Whether state q has an arc for token t."""
        born, left = self.born, self.left
        while True:
            if self.without[q] == t:
                return False
            if t in born and born[t] >= self.since[q]:
                if q == 0:
                    return True
                t = left[t]  # the gadget of t gave q an arc if q had one for its left part
            elif q == 0:
                return True
            else:
                q = self.parent[q]

    def encode(self, word: bytes) -> list[int]:
        """The tokens on the one path that spells word: longest arcs first; places without a way on are struck out."""
        ids, reach, table, to = self.ids, self.reach, self.table, self.to
        t = ids.get(word)
        if t is not None:
            return [t]  # a token that gadgets made, or a byte, is the encoding of its own bytes
        out: list[int] = []
        states = [0]
        pos, n, q = 0, len(word), 0
        dead: set[int] | None = None
        size = reach.get(word[:HEAD], HEAD - 1)
        if size > n:
            size = n
        while pos < n:
            row = table[q]
            if row is None:
                row = table[q] = {}
            while size > 0:
                t = ids.get(word[pos : pos + size])
                if t is not None and (dead is None or pos + size not in dead):
                    ok = row.get(t)
                    if ok is None:
                        ok = self.learn(q, row, t)
                    if ok:
                        break
                size -= 1
            if size > 0:
                out.append(t)
                q = to[t]
                states.append(q)
                pos += size
                size = reach.get(word[pos : pos + HEAD], HEAD - 1)
                if size > n - pos:
                    size = n - pos
            else:
                if not out:
                    raise ValueError("a byte of the text has no token")
                dead = dead or set()
                dead.add(pos)
                size = len(self.labels[out.pop()])
                states.pop()
                q = states[-1]
                pos -= size
                size -= 1
        return out

    def learn(self, q: int, row: dict[int, bool], t: int) -> bool:
        """Works out the arc of state q for token t and keeps it."""
        self.kept += 1
        if self.kept > ARCS:
            self.table = [None] * len(self.parent)
            self.kept = 0
            return self.has(q, t)
        row[t] = self.has(q, t)
        return row[t]

class Codec:
    """A byte-level BPE tokenizer file, as its library encodes and decodes with it."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton({i: as_bytes(s) for s, i in vocab.items() if i not in self.special.values() and s not in self.special}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        #: The library's own splitter, for scripts beyond Latin.
        self.other = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.labels = {str(i).encode(): x for i, x in self.automaton.labels.items()} | {str(i).encode(): s.encode() for s, i in self.special.items()}
        #: The ids in decimal.
        self.shown = {i: str(i).encode() for i in self.automaton.labels}
        self.known = _Known(self)

    def words(self, chunk: str) -> list[str]:
        if not BEYOND.search(chunk):
            return LATIN.findall(chunk)
        return [chunk[lo:hi] for _, (lo, hi) in self.other(chunk)]

    def chunk(self, chunk: str) -> bytes:
        encode, shown = self.automaton.encode, self.shown
        return b",".join([shown[t] for w in self.words(chunk) for t in encode(w.encode())])

    def parts(self, text: str) -> list[str]:
        """A text cut into words or, where it holds characters beyond Latin, chunks of some words."""
        return (CHUNK if BEYOND.search(text) else LATIN).findall(text)

    def encode_text(self, text: str) -> bytes:
        """The ids of a whole text in decimal, joined by commas."""
        known = self.known
        if len(known) > CACHE:
            known.turn()
        if self.split is None or not any(s in text for s in self.special):
            return b",".join(map(known.__getitem__, self.parts(text)))
        out = []
        for part in self.split(text):
            if part in self.special:
                out.append(b"%d" % self.special[part])
            elif part:
                out += map(known.__getitem__, self.parts(part))
        return b",".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text).split(b",") if x]

    def decode_ids(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, ids.split(b","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(b",".join(b"%d" % i for i in ids))


class _Known(dict):
    """Encoded chunks; one that is missing is encoded when asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            bare = chunk[1:] if chunk[0] == " " else chunk
            if bare.isalpha() and not BEYOND.search(bare):  # one word
                shown = self.codec.shown
                ids = b",".join([shown[t] for t in self.codec.automaton.encode(chunk.encode())])
            else:
                ids = self.codec.chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One compiled automaton for each worker and file."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """docs with the columns token_ids array<int> (if ids), n_tokens long and, if digests, ids_sha256, decoded_sha256.

    Whole texts; a null text counts as empty and has no tokens (an empty array, n_tokens 0). Rows stay where
    they are: there is no shuffle. Columns of docs that bear one of the new names are replaced; the order of
    the rest is kept. path: the tokenizer's file, which every executor must have.
    """
    import pyarrow as pa

    new = [("token_ids", "array<int>")] * ids + [("n_tokens", "bigint")] + [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests
    names = [n for n, _ in new]
    rest = [c for c in docs.columns if c not in names]
    src = docs.select(*[f"`{c}`" for c in rest])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema] + [f"{n} {t}" for n, t in new])
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out: list[list] = [[] for _ in new]
                for t in part.column(at):
                    s = c.encode_text(t.as_py() or "")
                    row: list = []
                    if ids:
                        row.append([int(x) for x in s.split(b",")] if s else [])
                    row.append(s.count(b",") + 1 if s else 0)
                    if digests:
                        row += [hashlib.sha256(s).hexdigest(), hashlib.sha256(c.decode_ids(s).encode()).hexdigest()]
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                kinds = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(o, kinds[k]) for o, (_, k) in zip(out, new, strict=True))], names=[*rest, *names])

    return src.mapInArrow(run, schema)


def decoded(docs: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """docs with decoded string, the text that ids spell; null ids give null, bytes that aren't UTF-8 the replacement sign."""

    @F.pandas_udf("string")
    def spell(col: pd.Series) -> pd.Series:
        c = codec(path)
        return col.map(lambda x: None if x is None else c.decode([int(i) for i in x]))

    return docs.withColumn("decoded", spell(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document doc_id, n_tokens, ids_sha256, decoded_sha256 of its whole text; repeated rows each give a row."""
    return encoded(docs.select("doc_id", "text"), path, ids=False, digests=True).drop("text")
