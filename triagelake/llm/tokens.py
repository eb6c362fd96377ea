"""Token counts: a Viterbi search that keeps counts only.

An Aho-Corasick automaton over a unigram vocabulary lists every piece that ends at each character. Dynamic programming
carries the best score and the number of tokens to each place; no segmentation is built. The tie rule is that of the
unigram tokenizer: among equal scores the piece that starts first wins, and an unknown character is tried last.

A piece has its space mark only in front, so a text falls apart into chunks in front of its space marks and at line
feeds, and chunks are counted once and remembered. The search holds as many places as the longest piece has characters, so a
long text without any break needs no more memory than itself.

The vocabulary is that of a public file with the scores that it states; tokenizers are never trained. Characters in no
piece fall back to their UTF-8 bytes, a token each.

Defined results: a null or empty text has 0 tokens; very long texts are read whole; repeated rows each get a row; an
empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

SPACE, PENALTY = "▁", 10.0
#: Characters of chunks, and as many for each entry, that a worker remembers before it starts anew; longer chunks never are.
REMEMBERED, ENTRY, LONG = 1 << 27, 200, 64
#: Characters of a text taken up at once; where a chunk always ends.
BLOCK, BREAK = 1 << 20, re.compile(f"[^{SPACE}\n](?={SPACE})|\n")
CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_COUNTERS: dict[str, Counter] = {}


def vocabulary(path: str) -> dict[str, float]:
    """The normal pieces of a sentencepiece file and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
    return {model.id_to_piece(k): model.get_score(k) for k in range(model.get_piece_size()) if not any(f(k) for f in odd)}


class Counter:
    """Counts tokens and sums scores by a unigram vocabulary."""

    def __init__(self, scores: dict[str, float], remembered: int = REMEMBERED) -> None:
        self.found = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - PENALTY
        self.whole = any("\n" in p or SPACE in p.lstrip(SPACE) for p in scores)  # then texts don't fall apart
        self.longest = max(map(len, scores), default=1)
        self.remembered, self.held, self.counts, self.scores = remembered, 0, {}, {}

    def best(self, chunk: str) -> tuple[int, float]:
        """(tokens, score) of the best path through the chunk. Only the places that a piece can start from are held."""
        n, ring = len(chunk), min(len(chunk) + 1, self.longest + 1)
        score, count = [None] * ring, [0] * ring
        score[0] = 0.0
        at = here = 0  # ends before this are settled
        single = False

        def settle() -> None:
            if at and not single:
                before = (at - 1) % ring
                tried = score[before] + self.unknown
                if score[here] is None or tried > score[here]:
                    score[here], count[here] = tried, count[before] + len(chunk[at - 1].encode())

        for last, (size, gain) in self.found.iter(chunk):
            while at <= last:
                settle()
                at, single = at + 1, False
                here = at % ring
                score[here] = None
            start = (at - size) % ring
            tried = score[start] + gain  # longest first: on equal scores the first stays
            if score[here] is None or tried > score[here]:
                score[here], count[here] = tried, count[start] + 1
            single = single or size == 1
        while at < n:
            settle()
            at, single = at + 1, False
            here = at % ring
            score[here] = None
        settle()
        return count[here], score[here]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if self.whole:
            return self.best(marked)
        tokens, total, at = 0, 0.0, 0
        while at < len(marked):
            found = BREAK.search(marked, at + BLOCK) if len(marked) - at > BLOCK else None
            end = found.start() + 1 if found else len(marked)
            n, score = self._block(marked[at:end] if at or found else marked)
            tokens, total, at = tokens + n, total + score, end
        return tokens, total

    def _block(self, marked: str) -> tuple[int, float]:
        counts, scores = self.counts, self.scores
        chunks = CHUNK.findall(marked)
        if self.held > self.remembered:
            counts.clear()
            scores.clear()
            self.held = 0
        long = 0, 0.0
        if len(marked) > LONG and max(map(len, chunks)) > LONG:
            once = [self.best(x) for x in chunks if len(x) > LONG]
            long = sum(n for n, _ in once), sum(s for _, s in once)
            chunks = [x for x in chunks if len(x) <= LONG]
        for new in set(chunks):
            if new not in counts:
                counts[new], scores[new] = self.best(new)
                self.held += len(new) + ENTRY
        return sum(map(counts.__getitem__, chunks)) + long[0], sum(map(scores.__getitem__, chunks)) + long[1]


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path or default_path())
        for batch in batches:
            found = [own.count(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
