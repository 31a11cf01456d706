"""Packing by lexical retrieval: windows filled with the BM25 neighbours of a seed document.

1. Documents are tokenised once; the tokens are also the index's terms, so the statistics
   of the whole corpus (documents, mean length, documents of every term) are a table
   no longer than the vocabulary, whatever the corpus.
2. A weighted min-hash of every document's terms is its place: documents that share rare
   terms lie near each other. Only the weights of this order are fitted on a bounded sample
   (``ORDER_ROWS``); every document is indexed, with statistics over all of them. Ranges of
   places, ties split by the id, are the partitions, so a group of copies of any size is spread.
3. A partition streams through shards of ``SHARD_TOKENS``: each has an inverted index
   of its documents. A seed's terms are looked up there, its unused neighbours come back best
   first and fill the window; the one that no longer fits is cut, and its rest seeds the
   next window. A window that a shard leaves open is filled from the next shard.

So every window is full but for one tail a partition, which is laid into sequences whose
lengths are powers of two and needs no padding either.

Defined cases: a null or empty text is the end id alone; a null id is packed as any other;
identical rows are packed as separate documents, in any order among them; a document
longer than a window fills windows of its own with all but its rest; an empty table gives
no rows; only the id and the text are read, whatever other columns are called. A text of any
length is one row, tokenised whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import bounded, hashed_sample, slices, stored

#: Tokens and documents of a shard, about; its index lies in one task's memory.
SHARD_TOKENS, SHARD_DOCS = 1 << 19, 4096
#: Tokens of a partition beyond which there are more partitions than the session's.
PARTITION_TOKENS = 1 << 25
#: Documents on which the order's weights are fitted.
ORDER_ROWS = 1000
#: Words whose ids a Python worker remembers at most; a batch of new ones always fits.
KNOWN_WORDS = 600_000
K1, B = 1.5, 0.75


END = "</w>"


def parts(token: str) -> list[str]:
    """The symbols that merging starts from; the last one has the word's end."""
    letters = token.removesuffix(END)
    return [*letters[:-1], letters[-1] + token[len(letters) :]]


def merges_to_itself(token: str, rank: dict[tuple[str, str], int]) -> bool:
    """Whether merging the token's own symbols, lowest rank and leftmost first, gives the token."""
    symbols = parts(token)
    while len(symbols) > 1:
        best, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
        if best == len(rank):
            return False
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return True


class WordBpe:
    """Ids of a word-level BPE tokenizer of the tokenizers library, each word merged once.

    White space separates words before anything else happens to them in tokenizers that
    drop it, so a text's ids are those of its words, one after another. Words of Latin
    letters and runs of marks are merged in bulk; others go through the whole library, as do
    texts with added tokens, and tokenizers of another make.

    Bulk merging goes by the rank of the merged token, the library's by that of the pair.
    Both are the same if every token comes out of its own symbols whole: then two
    neighbours that make up a token are the pair it was merged from. ``by_rank`` says so (``ranked``
    finds out); without it the library's model merges word by word.
    """

    #: Fixed value: lower-cased, white space dropped, split at letters, digits and others.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, by_rank: bool = False):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spec = spec["model"]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", ())]
        one, two = before[0], before[-1]
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and one.get("pattern") == {"Regex": self.SPLIT} and one.get("invert") and one.get("behavior") == "Removed" and two.get("type") == "ByteLevel" and not two.get("use_regex") and not two.get("add_prefix_space")
        self.by_words = self.by_words and self.spec["type"] == "BPE" and not self.spec.get("dropout") and self.spec.get("end_of_word_suffix") == END
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.by_words = self.by_words and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())) and not any(set(a) & set(" \t\n\r") for a in self.added)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.shown = {b: c for c, b in self.byte.items()}
        letters, marks = "a-zß-öø-ÿ", "!-&(-/:-@[-`{-~"  # the apostrophe goes with what follows it
        self.behind_letter = f"([{letters}])([{marks}])"
        self.odd = re.compile(f"^(?!(?:[{letters}]+|[{marks}]+)$).*$", re.MULTILINE).findall
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        self.bulk = self._bulk() if by_rank and self.by_words else None

    def _merges(self) -> list[tuple[str, str]]:
        return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in self.spec["merges"]]

    def ranked(self) -> bool:
        """Whether every token merges to itself, and ids are in the order of merges behind all single symbols."""
        if not self.by_words:
            return False
        merges, ids = self._merges(), self.spec["vocab"]
        made = [ids[a + b] for a, b in merges]
        single = [i for t, i in ids.items() if len(t.removesuffix(END)) == 1]
        if made != sorted(set(made)) or len(self._bytes()) != len(ids) or (made and max(single) > made[0]):
            return False
        rank = {m: i for i, m in enumerate(merges)}
        return all(merges_to_itself(a + b, rank) for a, b in merges)

    def _bytes(self) -> dict[bytes, int]:
        """Tokens as bytes, a word's end as byte 1."""
        return {bytes(self.byte[c] for c in t.removesuffix(END)) + b"\1" * t.endswith(END): i for t, i in self.spec["vocab"].items() if all(c in self.byte for c in t.removesuffix(END))}

    def _bulk(self):
        import tiktoken

        table = self._bytes()
        self.ends = np.zeros(max(table.values()) + 1, bool)
        self.ends[[i for t, i in table.items() if t.endswith(b"\1") and t != b"\1"]] = True
        return tiktoken.Encoding("own", pat_str="[^\1]+\1", mergeable_ranks=table, special_tokens={})._core_bpe.encode_to_tiktoken_buffer

    def pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of lower-case words of one kind of characters each."""
        if not self.bulk:
            return [self.pack([t.id for t in self.model.tokenize("".join(self.shown[b] for b in w.encode()))]) for w in words]
        ids = np.frombuffer(bytes(self.bulk("\1".join(words) + "\1", set())), "<u4")
        width = self.kind.itemsize
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
        data = ids.astype(self.kind).tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[str]) -> None:
        """Finds the ids of words that aren't known: letters or marks in bulk, others by the whole library."""
        odd = set(self.odd("\n".join(words)))
        self.known.update((w, self.whole(w) if w else b"") for w in odd)
        if plain := list(words.difference(odd)):
            self.known.update(zip(plain, self.merged(plain), strict=True))

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts as little-endian unsigned integers of ``kind``."""
        out = [b""] * len(texts)
        latin = []
        for i, t in enumerate(texts):
            # the four separators are white space to Python and Arrow but not to the library
            if not self.by_words or (t and (any(a in t for a in self.added) or any(c in t for c in "\x1c\x1d\x1e\x1f"))):
                out[i] = self.whole(t) if t else b""
            elif t:
                try:
                    t.encode("latin-1")
                    latin.append(i)
                except UnicodeEncodeError:
                    words = t.split()
                    self.meet(set(words))
                    out[i] = b"".join(map(self.known.__getitem__, words))
        if latin:
            for i, own in zip(latin, self.together([texts[i].lower() for i in latin]), strict=True):
                out[i] = own
        return out

    def meet(self, words: set[str]) -> None:
        """Sees to it that all of the words are known."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {"": b""}
            new = words
        if new:
            self.learn(new)

    def together(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of lower-case texts of Latin letters: each word is looked up once for all of them.

        Marks are set apart where they follow a letter; the tokenizer separates them there in any case.
        """
        import pyarrow.compute as pc

        apart = pc.replace_substring_regex(pa.array(texts, pa.string()), self.behind_letter, r"\1 \2")
        lists = pc.utf8_split_whitespace(apart)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        own = list(map(self.known.get, words))
        if None in own:
            self.meet(set(words))
            own = [self.known[w] for w in words]
        sizes = np.array([len(x) for x in own], np.int64) // self.kind.itemsize
        first, table = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(own), self.kind)
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - ends + n, n)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return (ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


_loaded: dict[tuple[str, bool], WordBpe] = {}


def bpe(path: str, by_rank: bool) -> WordBpe:
    """The tokenizer of a Python worker, with the words it has met in earlier tasks."""
    if (path, by_rank) not in _loaded:
        _loaded.clear()
        _loaded[path, by_rank] = WordBpe(path, by_rank)
    return _loaded[path, by_rank]


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Positive for every term, also for those that most documents have."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


def race(weights: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Arrival times of every term in every round: the least of a document is its min-hash by weight."""
    x = np.arange(len(weights), dtype=np.uint64)[None, :] + (np.arange(1, rounds + 1, dtype=np.uint64) << np.uint64(32))[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    uniform = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return -np.log(uniform) / np.maximum(weights, 1e-9)


def place(terms: np.ndarray, times: np.ndarray) -> int:
    """The first terms to arrive in each round, twenty bits each."""
    key = 0
    if len(terms):
        for row in times:
            key = key << 20 | int(terms[np.argmin(row[terms])])
    return key


def tokenised(docs: DataFrame, tokenizer: str, by_rank: bool, end_id: int, times: np.ndarray | None) -> DataFrame:
    """(id, ids, key) of every document, and behind them (term, df) of every task's documents."""
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("term", T.LongType()), T.StructField("df", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe(tokenizer, by_rank)
        last = words.pack([end_id])
        df = np.zeros(max(words.vocabulary, end_id + 1), np.int64)

        def out(*columns) -> pa.RecordBatch:
            n = max(len(c) for c in columns if c is not None)
            kinds = (batch.schema.field(0).type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        batch = None
        for batch in batches:
            sizes = [x or 0 for x in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for a, b in slices(sizes):
                ids, keys = [], []
                for own in words.encode(batch.column(1).slice(a, b - a).to_pylist()):
                    terms = np.unique(np.frombuffer(own, words.kind))
                    df[terms] += 1
                    keys.append(0 if times is None else place(terms, times))
                    ids.append(own + last)
                yield out(batch.column(0).slice(a, b - a), ids, [len(x) // words.kind.itemsize for x in ids], keys, None, None)
        if batch is not None:
            (terms,) = np.nonzero(df)
            if len(terms):
                yield out(None, None, None, None, terms, df[terms])

    import pyarrow.compute  # noqa: F401  (pa.compute is used in the tasks)

    return docs.select("id", "text").mapInArrow(run, schema)


def document_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """Documents of every term; rows no more than the vocabulary."""
    df = np.zeros(size, np.int64)
    for term, n in tokens.where("term is not null").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


class Shard:
    """An inverted index over the terms of some documents, with the corpus' own statistics."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray, mean: float):
        self.terms, tfs = [], []
        for ids in docs:
            t, n = np.unique(ids, return_counts=True)
            self.terms.append(t)
            tfs.append(n)
        sizes = np.array([len(t) for t in self.terms], np.int64)
        term = np.concatenate(self.terms).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        tf = np.concatenate(tfs).astype(np.float64) if len(docs) else np.zeros(0)
        length = np.array([len(d) for d in docs], np.float64)
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        score = weight[term] * tf * (K1 + 1) / (tf + norm[doc])
        by = np.argsort(term, kind="stable")
        self.doc, self.score = doc[by], score[by]
        self.start = np.searchsorted(term[by], np.arange(len(weight) + 1))
        self.left = np.ones(len(docs), bool)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document for a seed's terms."""
        first = self.start[terms]
        sizes = self.start[terms.astype(np.int64) + 1] - first
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)
        return np.bincount(self.doc[at], self.score[at], len(self.left))

    def neighbours(self, terms: np.ndarray) -> Iterator[tuple[int, float]]:
        """Unused documents, best first; equal scores in the shard's order."""
        found = np.where(self.left, self.scores(terms), -1.0)
        while len(found):
            best = int(np.argmax(found))
            if found[best] < 0:
                return
            yield best, float(found[best])
            found[best] = -1.0


class Filler:
    """Fills windows of ``capacity`` ids with seeds and what shards return for them."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence, self.filled = capacity, 0, 0
        self.seed: np.ndarray | None = None  # the terms of the open window's seed
        self.open: list[list] = []
        self.rows: list[list] = []  # document, start, length, sequence, offset, score

    def flush(self) -> None:
        for row in self.open:
            row[3] = self.sequence
        self.rows += self.open
        self.open, self.filled, self.seed, self.sequence = [], 0, None, self.sequence + 1

    def put(self, doc, start: int, n: int, score: float | None) -> int:
        """Places ids of a document, as many as fit; returns their number."""
        n = min(n, self.capacity - self.filled)
        self.open.append([doc, start, n, None, self.filled, score])
        self.filled += n
        if self.filled == self.capacity:
            self.flush()
        return n

    def shard(self, index: Shard, sizes: list[int]) -> None:
        """Places all documents of a shard; the last window may stay open."""
        start = [n - n % self.capacity for n in sizes]
        for d, whole in enumerate(start):  # whole windows of long documents
            for at in range(0, whole, self.capacity):
                self.rows.append([d, at, self.capacity, self.sequence, 0, None])
                self.sequence += 1
            index.left[d] = whole < sizes[d]
        rest, unseen = None, iter(range(len(sizes)))
        while True:
            if self.seed is None:
                d = rest if rest is not None else next((d for d in unseen if index.left[d]), None)
                if d is None:
                    return
                rest, index.left[d], self.seed = None, False, index.terms[d]
                self.put(d, start[d], sizes[d] - start[d], None)  # a rest is shorter than a window
            for d, score in index.neighbours(self.seed):
                index.left[d] = False
                start[d] += self.put(d, start[d], sizes[d] - start[d], score)
                rest = d if start[d] < sizes[d] else None
                if self.seed is None:
                    break
            else:
                return

    def close(self) -> None:
        """The open window's ids in sequences whose lengths are powers of two."""
        left, pieces, self.filled = self.filled, self.open, 0
        self.open = []
        for doc, start, n, _, _, score in pieces:
            while n:
                room = 1 << (left.bit_length() - 1)
                k = min(n, room - self.filled)
                self.open.append([doc, start, k, None, self.filled, score])
                start, n, self.filled = start + k, n - k, self.filled + k
                if self.filled == room:
                    left -= room
                    self.flush()


def pack(df: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and score, its BM25 for the window's seed."""
    spark = df.sparkSession
    bounded(spark)
    docs = df.select(F.col(doc).alias("id"), F.col(text).alias("text"))
    words = WordBpe(tokenizer)
    size, by_rank = max(words.vocabulary, end_id + 1), words.ranked()
    sample = tokenised(hashed_sample(docs, "id", ORDER_ROWS).repartition(spark.sparkContext.defaultParallelism), tokenizer, by_rank, end_id, None)
    fitted = document_counts(sample, size)
    times = race(idf(fitted, max(ORDER_ROWS, int(fitted.max(initial=0)))))
    tokens = stored(tokenised(docs, tokenizer, by_rank, end_id, times))
    n, total = tokens.where("term is null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight, mean, kind = idf(document_counts(tokens, size), n), (total - n) / max(n, 1), words.kind
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_TOKENS))
    ordered = tokens.where("term is null").select("id", "ids", "key", F.xxhash64("id").alias("__tie")).repartitionByRange(parts, "key", "__tie", "id").sortWithinPartitions("key", "__tie", "id", "ids")
    schema = T.StructType([T.StructField(doc, docs.schema["id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("score", T.DoubleType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        filler = Filler(capacity)

        def rows(data: list[bytes], id_of: list, kind_of_id: pa.DataType) -> pa.RecordBatch:
            """The placed pieces; an open one keeps its own document beside it."""
            done, filler.rows = filler.rows, []
            crc, tokens, names = [], [], []
            for d, start, k, *_ in done:
                own, name = (data[d], id_of[d]) if isinstance(d, int) else d
                ids = np.frombuffer(own, kind)
                crc.append(zlib.crc32(ids[start : start + k].astype("<u4")))
                tokens.append(len(ids))
                names.append(name)
            for row in filler.open:
                row[0] = (data[row[0]], id_of[row[0]]) if isinstance(row[0], int) else row[0]
            columns = [pa.array(names, kind_of_id), *[pa.array([r[i] for r in done], pa.int64()) for i in (1, 2)], pa.array(crc, pa.int64()), pa.array(tokens, pa.int64())]
            columns += [pa.array([first + r[3] for r in done], pa.int64()), pa.array([r[4] for r in done], pa.int64()), pa.array([r[5] for r in done], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def shard() -> pa.RecordBatch:
            ids = [np.frombuffer(x, kind) for x in data]
            filler.shard(Shard([x[:-1] for x in ids], weight, mean), [len(x) for x in ids])
            return rows(data, id_of, kind_of_id)

        data, id_of, held, kind_of_id = [], [], 0, None
        for batch in batches:
            kind_of_id = batch.schema.field(0).type
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data.append(own)
                id_of.append(name)
                held += len(own) // kind.itemsize
                if held >= SHARD_TOKENS or len(data) >= SHARD_DOCS:
                    yield shard()
                    data, id_of, held = [], [], 0
        if kind_of_id is not None:
            if data:
                yield shard()
            filler.close()
            yield rows([], [], kind_of_id)

    return ordered.select("id", "ids").mapInArrow(fill, schema)
