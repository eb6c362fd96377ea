"""LM scoring by masked pseudo-likelihood.

Every token of a document is masked in turn and predicted from the ``SIDE`` tokens on either side of it:

    log p(word | both sides) = log p(class | both sides) + log p(word | class)

The first factor is a window network's, trained in numpy. The second comes from counts over the whole corpus. Their sum
over a document's tokens is its score.

1. Words are counted over all texts, summed in the tasks that read them. The head are the words that make up ``SHARE`` of
   all tokens or more, so ``1 / SHARE`` of them at most at any size: they have an embedding each, and classes by frequency.
   The other words, whose number grows with the corpus, stay in the distributed table of counts; their class is that of
   their last bytes.
2. The network reads embeddings of the tokens on both sides and gives the classes' distribution. It is trained by rounds
   of local steps: every task trains a copy on the round's documents that it reads, and the copies are averaged by the
   tokens that each has seen, block by block of the parameters. Documents are dealt to the rounds, so each trains once.
3. Texts are scored where they are read. What words of the tail add is known only where their counts are: (row, word)
   pairs go there, and come back as a sum a row. A word's count leaves out the document's own uses, so a document is
   scored by what the others have: words that no other document has are the least likely ones.

Defined results: a null or blank text has no tokens, score 0 and null means; very long texts are read whole, in pieces
that overlap by the window; repeated rows count as other documents and are scored each; words are told apart by 64-bit
hashes; an empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.

Counting, training and scoring read texts as arrays of words, hashed and looked up together; only words of 32 bytes or more
are hashed one by one.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, texts_of

#: A word of the head makes up this share of all tokens, and occurs so often that its embedding can be learned.
SHARE, LEAST = 1e-5, 50
#: Classes of the head's words by frequency, and of the others by their last bytes.
HEADS, TAILS, LAST_BYTES = 96, 32, 2
#: Tokens read on either side; sizes of the network; what a word of the tail counts besides its uses elsewhere.
SIDE, EMBEDDING, HIDDEN, SMOOTH = 2, 24, 64, 0.05
#: Rounds, so many that each document trains in one of them; tokens of a batch; a step's size.
ROUNDS, BATCH, RATE = 2, 512, 0.08
#: Distinct words that a task holds; tokens that are scored at once; numbers in a block of parameters.
HELD, CHUNK, BLOCK = 400_000, 8192, 1 << 16
#: Bytes of a text for each token of a chunk; words that are hashed at once.
TOKEN_BYTES, HASHED = 6, 1 << 14
#: XXH64's primes and the size from which words take its long form.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
LONG = 32
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-LAST_BYTES:]) % TAILS


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


@released
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, tail, n) for the words of a task's texts, once each if they are no more than ``HELD``."""
    reader, held, waiting = Reader(Vocabulary(np.zeros(0, np.int64), *np.zeros((3, 0)))), [], 0

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by("h", use_threads=False).aggregate([("tail", "min"), ("n", "sum")])
        return sums.select(["h", "tail_min", "n_sum"]).rename_columns(["h", "tail", "n"])

    for batch in batches:
        for _, keys, ids in reader.read(batch.column("text")):
            held.append(pa.table({"h": keys, "tail": ids - np.int32(reader.first_tail), "n": np.ones(len(keys), np.int64)}))
            waiting += len(keys)
            if waiting >= HELD:
                held, waiting = [merged()], 0
                if held[0].num_rows > HELD:
                    yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, tail, n) for every word of the corpus: its hash, its class if it is none of the head's, its uses."""
    return docs.select("text").mapInArrow(counted, "h long, tail int, n long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head (hashes, most frequent first, and their counts) and each tail class' tokens and distinct words.

    Token 0 lies beyond either end of a text, then come the words of the head, then the tail's classes.
    """

    head: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    def __post_init__(self) -> None:
        mass = np.cumsum(np.sqrt(self.counts))
        total = float(mass[-1]) if len(mass) else 1.0
        self.place = np.minimum(HEADS - 1, ((mass - np.sqrt(self.counts)) * HEADS / total).astype(np.int64))
        self.size = 1 + len(self.head) + TAILS
        self.classes = np.concatenate(([0], self.place, HEADS + np.arange(TAILS)))
        self.class_tokens = np.concatenate((np.bincount(self.place, self.counts, HEADS), self.tokens))
        whole = np.maximum(self.class_tokens[self.place], 1)
        tail = -np.log(self.tokens + SMOOTH * (self.words + 1))
        #: For the head log p(word | class); for the tail what all words of a class have in common of it.
        self.within = np.concatenate(([0.0], np.log(self.counts / whole), tail)).astype(np.float32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """At most ``1 / SHARE`` words and ``TAILS`` sums reach the driver."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(float(LEAST), total * SHARE)
    head = counts.where(F.col("n") >= least).select("h", "n").toArrow()
    h, n = (head.column(c).to_numpy() for c in ("h", "n"))
    order = np.lexsort((h, -n))
    tokens, words = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.where(F.col("n") < least).groupBy("tail").agg(F.sum("n"), F.count("*")).collect():
        tokens[r[0]], words[r[0]] = r[1], r[2]
    return Vocabulary(h[order], n[order].astype(np.float64), tokens, words)


def rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def digests(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of each word, as ``xxhash`` gives it. ``LONG`` bytes must follow the last word in ``data``."""
    windows = np.ndarray(len(data) - LONG + 1, f"V{LONG}", data, strides=(1,))
    lanes = windows[starts].view("<u8").reshape(-1, LONG // 8).T
    full, h = sizes >> 3, sizes.astype(np.uint64) + P5
    for k in range(LONG // 8 - 1):
        on = np.flatnonzero(full > k)
        if len(on):
            h[on] = rotated(h[on] ^ rotated(lanes[k][on] * P2, 31) * P1, 27) * P1 + P4
    rest = lanes[np.minimum(full, LONG // 8 - 1), np.arange(len(sizes))]
    on = np.flatnonzero(sizes & 4)
    h[on] = rotated(h[on] ^ (rest[on] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    rest[on] >>= np.uint64(32)
    for k in range(3):
        on = np.flatnonzero((sizes & 3) > k)
        h[on] = rotated(h[on] ^ ((rest[on] >> np.uint64(8 * k)) & np.uint64(255)) * P5, 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(sizes >= LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]].tobytes())
    return h


@functools.cache
def endings() -> np.ndarray:
    """Tail classes of words by their last two bytes, the last one lower; then of words of one byte."""
    return np.array([tail_class(bytes(divmod(k, 256))) for k in range(1 << 16)] + [tail_class(bytes([k])) for k in range(256)], np.int32)


class Reader:
    """Texts to tokens. The head's hashes lie in order, found by their first bits."""

    def __init__(self, vocab: Vocabulary) -> None:
        head = vocab.head.view(np.uint64) ^ np.uint64(1 << 63)
        order, bits = np.argsort(head), len(head).bit_length() + 3
        self.first_tail, self.shift = 1 + len(head), np.uint64(64 - bits)
        self.low = np.searchsorted(head[order], np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.deep = int(np.diff(self.low, append=len(head)).max())
        self.head, self.tokens = np.append(head[order], np.zeros(self.deep, np.uint64)), np.append(order + 1, np.zeros(self.deep, np.int64)).astype(np.int32)

    def looked_up(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and token ids of words, none empty, in bytes as ``digests`` takes them."""
        keys, ids = np.empty(len(starts), np.int64), np.empty(len(starts), np.int32)
        for lo in range(0, len(starts), HASHED):
            start, size = starts[lo : lo + HASHED], sizes[lo : lo + HASHED]
            found, last = digests(data, start, size), start + size - 1
            before = np.where(size > 1, data[last - 1].astype(np.int32), 256)
            token, first = endings()[before * 256 + data[last]] + np.int32(self.first_tail), self.low[found >> self.shift]
            for k in range(self.deep):
                head = np.where(self.head[first + k] == found, self.tokens[first + k], 0)
                token = np.where(head > 0, head, token)
            keys[lo : lo + HASHED], ids[lo : lo + HASHED] = (found ^ np.uint64(1 << 63)).view(np.int64), token
        return keys, ids

    def ids(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return self.looked_up(np.frombuffer(b"".join(words) + bytes(LONG), np.uint8), np.cumsum(sizes) - sizes, sizes)[1]

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts in runs of about a chunk's tokens, or of one text: the tokens of each text; keys and ids of all of them."""
        _, places, data = texts.buffers()
        kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        edges = np.frombuffer(places, kind, len(texts) + 1, kind.itemsize * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data, void, lo = np.frombuffer(data or b"", np.uint8), texts.is_null().to_numpy(zero_copy_only=False), 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + TOKEN_BYTES * CHUNK, "right")) - 1)
            part = np.concatenate((data[edges[lo] : edges[hi]], np.zeros(LONG, np.uint8)))
            ends = edges[lo : hi + 1] - edges[lo]
            for k in np.flatnonzero(void[lo:hi]).tolist():
                part[ends[k] : ends[k + 1]] = 32
            part += ((part - 65) < 26).view(np.uint8) << 5  # A-Z in lower case
            inside = (part[: ends[-1]] != 32) & (part[: ends[-1]] - 9 >= 5)
            starts, stops, cuts = inside.copy(), inside.copy(), ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < ends[-1])]
            starts[1:] &= ~inside[:-1]
            stops[:-1] &= ~inside[1:]
            starts[cuts], stops[cuts - 1] = inside[cuts], inside[cuts - 1]
            starts = np.flatnonzero(starts)
            yield np.diff(np.searchsorted(starts, ends)), *self.looked_up(part, starts, np.flatnonzero(stops) + 1 - starts)
            lo = hi


def spread(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of texts of these sizes with ``SIDE`` zeros before, between and after the texts, and the places of the tokens."""
    at = np.arange(len(ids)) + np.repeat(SIDE * np.arange(1, len(sizes) + 1), sizes)
    flat = np.zeros(len(ids) + SIDE * (len(sizes) + 1), np.int32)
    flat[at] = ids
    return flat, at


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``spread`` of the texts' ids."""
    return spread(np.concatenate([np.zeros(0, np.int32), *texts]), np.fromiter(map(len, texts), np.int64, len(texts)))


def tanh(x: np.ndarray) -> np.ndarray:
    """In place, by exponentials, which numpy takes faster; where they overflow the result is 1 as it should be."""
    x += x
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


class Network:
    """log p(class | tokens on both sides). Parameters are float32 and travel as one array."""

    def __init__(self, vocab: Vocabulary, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        weights = [rng.normal(0, 0.1, s) for s in ((vocab.size, EMBEDDING), (len(PLACES) * EMBEDDING, HIDDEN))]
        bias = np.log((vocab.class_tokens + 1) / (vocab.class_tokens + 1).sum())
        weights += [np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, HEADS + TAILS)), bias]
        self.classes, self.weights = vocab.classes, [w.astype(np.float32) for w in weights]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def load(self, flat: np.ndarray) -> None:
        ends = np.cumsum([w.size for w in self.weights])[:-1]
        self.weights = [part.reshape(w.shape).astype(np.float32) for part, w in zip(np.split(flat, ends), self.weights)]

    def tables(self) -> list[np.ndarray]:
        """What each token adds to the hidden layer at each place."""
        emb, hidden = self.weights[0], self.weights[1]
        return [emb @ hidden[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(len(PLACES))]

    def exponentials(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of hidden layers and each one's class: exponentials that make the classes' probabilities if multiplied by a share
        of each class and divided by a number of each row; these shares and numbers; log p of the row's class."""
        _, _, _, o, ob = self.weights
        z, spots = h @ o, self.spots(target)
        if np.abs(o).sum(axis=0).max() + np.abs(ob).max() < 60:  # no exponential can overflow, nor all be 0
            share, at = np.exp(ob), z.ravel().take(spots) + ob.take(target)
        else:
            z += ob
            z -= z.max(axis=1, keepdims=True)
            share, at = np.ones_like(ob), z.ravel().take(spots)
        np.exp(z, out=z)
        whole = z @ share
        return z, share, whole, at - np.log(whole)

    @staticmethod
    def spots(target: np.ndarray) -> np.ndarray:
        """Where each row's class lies among all rows' classes."""
        return np.arange(len(target)) * (HEADS + TAILS) + target

    def score(self, tables: list[np.ndarray], flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p(class of the token | both sides) at the places."""
        out, hb = np.empty(len(at), np.float32), self.weights[2]
        for lo in range(0, len(at), BATCH):
            here = at[lo : lo + BATCH]
            x = tables[0].take(flat.take(here + PLACES[0]), axis=0)
            for table, k in zip(tables[1:], PLACES[1:]):
                x += table.take(flat.take(here + k), axis=0)
            x += hb
            out[lo : lo + len(here)] = self.exponentials(tanh(x), self.classes.take(flat.take(here)))[3]
        return out

    def train(self, flat: np.ndarray, at: np.ndarray, squares: list[np.ndarray]) -> float:
        """One pass over the places in batches, with steps scaled by the squares of past gradients; the mean loss."""
        return -sum(self.step(flat, at[lo : lo + BATCH], squares) for lo in range(0, len(at), BATCH)) / max(1, len(at))

    def step(self, flat: np.ndarray, here: np.ndarray, squares: list[np.ndarray]) -> float:
        """Trains on a batch of places in order; the sum of log p. What lies between texts has rows too, of no weight."""
        emb, hidden, hb, o, ob = self.weights
        rows, ids = here - here[0], flat[here[0] - SIDE : here[-1] + SIDE + 1]
        wide, near = len(ids) - 2 * SIDE, emb.take(ids, axis=0)
        x = np.concatenate([near[SIDE + k : SIDE + k + wide] for k in PLACES], axis=1)
        h = x @ hidden
        h += hb
        target = self.classes.take(ids[SIDE : SIDE + wide])
        d, share, whole, logp = self.exponentials(tanh(h), target)
        d.reshape(-1)[self.spots(target)] -= whole / share.take(target)
        weight = np.zeros(wide, np.float32)
        weight[rows] = 1 / (whole[rows] * np.float32(len(here)))
        dh = d @ (o * share).T
        go, gob = (h * weight[:, None]).T @ d * share, weight @ d * share
        h *= h
        np.subtract(1, h, out=h)
        h *= weight[:, None]
        dh *= h
        # what each place gets from the tokens on both sides of it, then summed by word
        dx, around = dh @ hidden.T, np.zeros((len(ids), EMBEDDING), np.float32)
        for j, k in enumerate(PLACES):
            around[SIDE + k : SIDE + k + wide] += dx[:, j * EMBEDDING : (j + 1) * EMBEDDING]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        used, de = ids[starts], np.add.reduceat(around.take(order, axis=0), starts, axis=0)
        for w, g, sq in ((hidden, x.T @ dh, squares[1]), (hb, dh.sum(axis=0), squares[2]), (o, go, squares[3]), (ob, gob, squares[4])):
            sq += g * g
            w -= RATE * g / np.sqrt(sq + 1e-6)
        square = squares[0].take(used, axis=0) + de * de
        squares[0][used] = square
        emb[used] = emb.take(used, axis=0) - RATE * de / np.sqrt(square + 1e-6)
        return float(logp[rows].sum())


def dealt(docs: DataFrame, share: int = ROUNDS, rounds: int = ROUNDS) -> list[DataFrame]:
    """The texts of each round: one of ``share`` equal parts after the other, all of them if the rounds are as many."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(share))
    return [docs.where(part == k % share).select("text") for k in range(rounds)]


def trained(docs: DataFrame, vocab: Vocabulary, share: int = ROUNDS, rounds: int = ROUNDS) -> Network:
    """The network after its rounds. A round's copies are summed block by block in streams; the driver gets one sum."""
    net = Network(vocab)
    for texts in dealt(docs, share, rounds):
        start = net.flat()

        @released
        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            own, reader, n, waiting = Network(vocab), Reader(vocab), 0, 0
            own.load(start)
            squares = [np.zeros_like(w) for w in own.weights]
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def finish() -> None:
                ids, sizes = (np.concatenate(x) for x in zip(*held))
                own.train(*spread(ids, sizes), squares)
                held.clear()

            for batch in batches:
                for sizes, _, ids in reader.read(batch.column("text")):
                    held.append((ids, sizes))
                    waiting += len(ids)
                    if waiting >= CHUNK:
                        finish()
                        n, waiting = n + waiting, 0
            if waiting:
                finish()
                n += waiting
            if n:
                moved = (own.flat() - start) * np.float32(n)
                parts = [moved[k : k + BLOCK].tobytes() for k in range(0, len(moved), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "n", "moved"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, n, total = None, 0, None
            for batch in batches:
                for block, more, part in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("moved")):
                    values = np.frombuffer(part.as_py(), np.float32)
                    if block != key:
                        if key is not None:
                            yield pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int32()), "n": [n], "moved": [total.tobytes()]})
                        key, n, total = block, 0, np.zeros(len(values))
                    n, total = n + more, total + values
            if key is not None:
                yield pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int32()), "n": [n], "moved": [total.tobytes()]})

        schema = "block int, n long, moved binary"
        blocks = texts.mapInArrow(run, schema).repartition("block").sortWithinPartitions("block").mapInArrow(summed, schema).toArrow()
        if not blocks.num_rows:
            break
        parts = {b: np.frombuffer(m, np.float64) / n for b, n, m in zip(*(blocks.column(c).to_pylist() for c in ("block", "n", "moved")))}
        net.load(start + np.concatenate([parts[b] for b in sorted(parts)]).astype(np.float32))
    return net


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score (sum of log-probabilities), mean_score, n_unseen (tokens whose word no other document has), unseen_share."""
    counts = cut(word_counts(docs))
    vocab = vocabulary(counts)
    return scored(docs, counts, vocab, trained(docs, vocab))


def scored(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, net: Network) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tables = Reader(vocab), net.tables()
        for batch in batches:
            columns: list[tuple[pa.Array, ...]] = []
            for sizes, keys, ids in reader.read(batch.column("text")):
                logp = net.score(tables, *spread(ids, sizes)).astype(np.float64) + vocab.within[ids]
                row = np.repeat(np.arange(len(sizes)), sizes)
                rare = np.flatnonzero(ids >= reader.first_tail)
                rare = rare[np.lexsort((keys[rare], row[rare]))]
                first = np.flatnonzero((np.diff(row[rare], prepend=-1) != 0) | (np.diff(keys[rare], prepend=0) != 0))
                ends = pa.array(np.searchsorted(row[rare[first]], np.arange(len(sizes) + 1)), pa.int32())
                tails, uses = pa.array(keys[rare[first]], pa.int64()), pa.array(np.diff(first, append=len(rare)), pa.int32())
                columns.append((pa.array(sizes, pa.int64()), pa.array(np.bincount(row, logp, len(sizes))), *(pa.ListArray.from_arrays(ends, x) for x in (tails, uses))))
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("rid"), *map(pa.concat_arrays, zip(*columns))],
                    ["doc_id", "rid", "n_tokens", "part", "tails", "uses"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")
    rows = cut(numbered.mapInArrow(run, f"doc_id {kind}, rid long, n_tokens long, part double, tails array<long>, uses array<int>"))
    pairs = rows.select("rid", F.explode(F.arrays_zip("tails", "uses")).alias("word")).select("rid", F.col("word.tails").alias("h"), F.col("word.uses").alias("k"))
    elsewhere = F.col("n") - F.col("k")
    met = pairs.join(counts.select("h", "n").hint("shuffle_hash"), "h").select("rid", "k", elsewhere.alias("others"))
    sums = met.groupBy("rid").agg(
        F.sum(F.col("k") * F.log(F.col("others") + F.lit(SMOOTH))).alias("tail"), F.sum(F.when(F.col("others") == 0, F.col("k")).otherwise(0)).alias("unseen")
    )
    out = rows.select("doc_id", "rid", "n_tokens", "part").join(sums, "rid", "left")
    score, unseen, size = F.col("part") + F.coalesce("tail", F.lit(0.0)), F.coalesce("unseen", F.lit(0)).cast("long"), F.nullif("n_tokens", F.lit(0))
    return out.select("doc_id", "n_tokens", score.alias("score"), (score / size).alias("mean_score"), unseen.alias("n_unseen"), (unseen / size).alias("unseen_share"))
