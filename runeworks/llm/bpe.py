"""Problem 7: encoding the corpus with a public byte-level BPE, by speculation and verification."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("RUNEWORKS_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pattern that splits text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Rows of one Arrow batch that are encoded together, words kept in a worker's cache, and
# the longest word, in bytes, that is worth keeping there.
SLICE, CACHED_WORDS, CACHED_BYTES = 1000, 400_000, 64


def words(text: Column) -> Column:
    """The words of ``text`` as the tokenizer splits it, inside the JVM; null gives no words."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + WORD_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


class WordEncoder:
    """Token ids of single words, exact and cached."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks: dict[bytes, int] = {base64.b64decode(t): int(r) for t, r in pairs}
        self.longest = max(map(len, self.ranks))
        self.vocab = max(self.ranks.values()) + 1
        self.spelled: list[bytes] = [b""] * self.vocab
        for spelling, rank in self.ranks.items():
            self.spelled[rank] = spelling
        self.fits: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact encoding: merge the adjacent pair of lowest rank, leftmost first, until none is left.

        A heap of candidate merges over a linked list, so a word of n bytes costs n log n.
        """
        ranks, n = self.ranks, len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                heap.append((rank, i, 2))
        heapq.heapify(heap)
        while heap:
            rank, i, size = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != rank:
                continue
            part[i] += part[j]
            part[j] = b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    both = part[left] + part[right]
                    found = ranks.get(both)
                    if found is not None:
                        heapq.heappush(heap, (found, left, len(both)))
        return tuple(ranks[p] for p in part if p)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        ranks, i, n, out = self.ranks, 0, len(word), []
        while i < n:
            for size in range(min(self.longest, n - i), 0, -1):
                rank = ranks.get(word[i : i + size])
                if rank is not None:
                    out.append(rank)
                    i += size
                    break
            else:
                raise ValueError(f"the rank file has no token for byte {word[i]}")
        return out

    def _verdicts(self, keys: np.ndarray, known: dict[int, bool], test: Callable[[int], bool]) -> np.ndarray:
        different, where = np.unique(keys, return_inverse=True)
        answers = np.empty(len(different), dtype=bool)
        for k, key in enumerate(different.tolist()):
            answer = known.get(key)
            if answer is None:
                answer = known[key] = test(key)
            answers[k] = answer
        return answers[where]

    def _pair_fits(self, key: int) -> bool:
        a, b = divmod(key, self.vocab)
        return self.merge(self.spelled[a] + self.spelled[b]) == (a, b)

    def _token_sound(self, token: int) -> bool:
        return self.merge(self.spelled[token]) == (token,)

    def encode_new(self, fresh: list[str]) -> list[tuple[int, ...]]:
        """Encodings of words that the cache lacks.

        A token sequence is the encoding of its text exactly if each token and each adjacent
        pair is the encoding of its own text. All tokens and pairs of all proposals are
        checked at once; only words with a failing one are merged exactly.
        """
        raw = [w.encode("utf-8") for w in fresh]
        proposals = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(proposals)), lengths)
        failing = set(owner[~self._verdicts(flat, self.sound, self._token_sound)].tolist())
        if len(flat) > 1:
            inside = owner[:-1] == owner[1:]
            keys = (flat[:-1] * self.vocab + flat[1:])[inside]
            failing.update(owner[:-1][inside][~self._verdicts(keys, self.fits, self._pair_fits)].tolist())
        return [self.merge(raw[i]) if i in failing else tuple(p) for i, p in enumerate(proposals)]

    def encode_words(self, different: list[str]) -> list[tuple[int, ...]]:
        """Encodings of ``different`` words, through the cache."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if len(self.fits) > 4 * CACHED_WORDS:
            self.fits.clear()
        out = [self.known.get(w) for w in different]
        fresh = [i for i, ids in enumerate(out) if ids is None]
        if fresh:
            for i, ids in zip(fresh, self.encode_new([different[i] for i in fresh])):
                out[i] = ids
                if len(different[i]) <= CACHED_BYTES:
                    self.known[different[i]] = ids
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for the rank file ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def rank_file(tokenizer: str, folder: str = TOKENIZERS) -> str:
    """Where the ranks of ``tokenizer`` are."""
    return os.path.join(folder, tokenizer + ".tiktoken")


class Encoded:
    """The words of a slice of rows: ``different`` words, and for each row the ``place`` of its words in them."""

    def __init__(self, lists: pa.Array, coder: WordEncoder) -> None:
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        self.different: list[str] = coded.dictionary.to_pylist()
        self.place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_row = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row_ends = np.concatenate(([0], np.cumsum(per_row)))
        self.ids = coder.encode_words(self.different)
        self.sizes = np.fromiter(map(len, self.ids), dtype=np.int64, count=len(self.ids))

    def sum_by_row(self, per_word: np.ndarray) -> np.ndarray:
        """Sums over each row's words of ``per_word``, given for each different word."""
        total = np.zeros((len(self.place) + 1, *per_word.shape[1:]), dtype=per_word.dtype)
        np.cumsum(per_word[self.place], axis=0, out=total[1:])
        return total[self.row_ends[1:]] - total[self.row_ends[:-1]]

    def counts(self) -> np.ndarray:
        """Tokens of each row."""
        return self.sum_by_row(self.sizes)

    def id_lists(self) -> pa.Array:
        """Token ids of each row."""
        flat = np.fromiter((t for ids in self.ids for t in ids), dtype=np.int32, count=int(self.sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        sizes = self.sizes[self.place]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(int(ends[-1])) - np.repeat(ends[:-1], sizes) + np.repeat(starts[self.place], sizes)
        return pa.ListArray.from_arrays(pa.array(ends[self.row_ends].astype(np.int32)), pa.array(flat[at]))


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded length."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def encode_documents(
    documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``doc_id, ids``: the token ids of every text, without special tokens.

    Every row of the input gives a row of the result. Null and empty texts have the empty
    list of ids; the spelling of a special token inside a text is ordinary text. Rows are
    encoded where they are read: there is no shuffle. Texts and words may be of any length.
    """
    path = rank_file(tokenizer, folder)
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), Encoded(part.column(1), coder).id_lists()], names=[key, "ids"])

    return documents.select(key, words(F.col(text)).alias("__w")).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def count_tokens(rows: DataFrame, text: str, path: str) -> DataFrame:
    """``rows`` with its column ``text`` replaced by ``tokens``, the number of tokens of each text."""
    rest = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for part in slices(batches):
            counts = Encoded(part.column(len(rest)), coder).counts()
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(counts)], names=[*rest, "tokens"])

    return rows.select(*rest, words(F.col(text)).alias("__w")).mapInArrow(count, f"{schema}, tokens bigint")
