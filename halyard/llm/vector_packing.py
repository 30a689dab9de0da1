"""Vector bin packing of tokenized examples under limits on tokens, segments and loss-bearing tokens.

Sequences are filled one after the other. Of the examples that fit whole into
what is left of the open sequence, in every limit, the one with the greatest
dot product of its needs with what is left, both as parts of their limits, goes
in: long examples while there is much room, and those that need most of what
there is most of. Where none fits whole, the longest is cut to fill the rest.
A sequence that its limits don't let fill is cut back to a power of two, which
needs no padding, and what was cut off waits for the next; so no sequence is
padded, and there are as many as the tokens ask for and a few short ones.

Each task packs its own rows: examples wait in a pool of bounded size, which is
worked off to a quarter whenever it is full, and to the end with the last row.
Nothing is shuffled, ranked or collected; a task that is run again gives its
sequences again. A text's ids are held whole.

Loss-bearing are an example's tokens after its first ``context`` ones: for
plain documents all, for instructions those after the prompt.

Defined results
    null or empty text: the end token alone; null prompt: no prompt; null
    doc_id: packed as it is; repeated rows and repeated doc_ids: packed each;
    ties: the example that waits longest; empty table: no rows; very long texts:
    cut into as many pieces as needed; further columns, also those named like
    the result's: left out.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1
#: Distinct words whose ids a worker keeps, over all its tasks; words of more bytes are encoded anew.
CACHED_WORDS, CACHED_LENGTH = 800_000, 96
#: Text encoded at a time.
GROUP_BYTES = 12_000_000
#: Tokens and examples that a task lets wait.
POOL_TOKENS, POOL_EXAMPLES = 2_000_000, 1024
#: sequence_id: the task's number and the sequence's number in it.
SEQUENCE_BITS = 40
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)
#: White space, as the tokenizer sees it, other than the blank and the line feed.
OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a text has none of whose words can be encoded one by one.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "<|", *OTHER_SPACE)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ByteEncoder:
    """The process's encoder: tasks that follow each other in a worker share its words."""
    return ByteEncoder(path)


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of so many values that begin at the starts, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class ByteEncoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer splits before every lone blank and around every lone line
    feed before it joins anything, so a text's ids are those of its words, each
    with the blank or line feed before it. Many texts are cut into words at a
    time, and each distinct word is looked up once; words new to a worker are
    encoded together and told apart by the tokens that begin with a blank or
    line feed. A full stop or comma between a letter and the end of a word is
    split off as well. When too many words are known, those of the last texts
    are kept. Texts with other white
    space or special tokens are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.first = np.zeros(max(vocab.values()) + 1, bool)
        self.first[[k for t, k in vocab.items() if t[0] in "\u0120\u010a"]] = True  # how byte-level vocabularies write blank and line feed
        self.stop, self.comma = self._whole(".")[0], self._whole(",")[0]
        self.known = pa.array([], pa.large_string())
        self.tokens, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)  # of the known words, one after the other

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: pa.Array) -> None:
        """Words begin with a line feed, or else stand behind a blank."""
        before = pc.if_else(pc.starts_with(words, "\n"), "", " ").cast(pa.large_string())
        spaced = pc.binary_join_element_wise(before, words, pa.scalar("", pa.large_string()))
        data = self._whole("".join(spaced.to_pylist()))
        starts = np.flatnonzero(self.first[data])
        if len(starts) != len(words):
            raise ValueError("the vocabulary doesn't part words as it should")
        self.known = pa.concat_arrays([self.known, words])
        self.tokens = np.concatenate((self.tokens, data))
        self.sizes = np.concatenate((self.sizes, np.diff(np.append(starts, len(data)))))

    def _keep(self, at: np.ndarray) -> None:
        """Forget all known words but those at the given places, and those that are too long."""
        length = pc.binary_length(self.known.take(pa.array(at))).to_numpy()
        at = at[length <= CACHED_LENGTH]
        self.tokens = _gathered(self.tokens, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at])
        self.known, self.sizes = self.known.take(pa.array(at)), self.sizes[at]

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of distinct words, one after the other, and how many each has."""
        marked = pc.match_substring_regex(words, r"\pL[.,]\z")
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        at = pc.index_in(stems.dictionary, value_set=self.known)
        if at.null_count:
            new = stems.dictionary.filter(pc.is_null(at))
            at = at.to_numpy(zero_copy_only=False)
            at[np.isnan(at)] = len(self.known) + np.arange(len(new))
            self._learn(new)
        at = np.asarray(at).astype(np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        place, marked = at[stems.indices.to_numpy()], marked.to_numpy(zero_copy_only=False)
        sizes = self.sizes[place] + marked
        out = _gathered(np.append(self.tokens, np.uint32(0)), starts[place], sizes)  # a mark's place holds another token for now
        out[np.cumsum(sizes)[marked] - 1] = np.where(pc.ends_with(words.filter(pa.array(marked)), ".").to_numpy(zero_copy_only=False), self.stop, self.comma)
        if len(self.known) > CACHED_WORDS:
            self._keep(np.sort(at))
        return out, sizes

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        even: list[int] = []
        for k, t in enumerate(texts):
            if not t or t[0].isspace() or t[-1].isspace() or any(map(t.__contains__, UNEVEN)):
                out[k] = self._whole(t).tobytes() if t else b""
            else:
                even.append(k)
        if not even:
            return out
        joined = "".join(["\n" + texts[k] for k in even]).replace("\n", " \n")
        coded = pc.split_pattern(pa.array([joined], pa.large_string()), " ").flatten()[1:].dictionary_encode()
        index = coded.indices.to_numpy()
        table, sizes = self._look_up(coded.dictionary)
        own = sizes[index]
        data, ends = _gathered(table, (np.cumsum(sizes) - sizes)[index], own).tobytes(), np.cumsum(own)
        words = np.cumsum([texts[k].count(" ") + texts[k].count("\n") + 1 for k in even])
        upto = (4 * ends[words - 1]).tolist()
        for k, a, b in zip(even, [0, *upto[:-1]], upto, strict=True):
            out[k] = data[a + 4 : b]  # without the line feed put before it
        return out


class Pool:
    """Examples that wait, and how sequences are filled from them."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, weights: tuple[float, float, float]):
        if min(capacity, max_segments, max_loss) < 1 or capacity & (capacity - 1):
            raise ValueError("limits start at 1, and the capacity is a power of two")
        self.limits = np.array([capacity, max_segments, max_loss], dtype=np.float64)
        self.pull = np.asarray(weights, dtype=np.float64) / self.limits**2
        self.named: list[tuple] = []  # of each example: doc_id, ids, tokens
        self.left, self.context = np.zeros(0, np.int64), np.zeros(0, np.int64)  # tokens, and those of them without loss
        self.fresh: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, ids: bytes, context: int = 0) -> None:
        n = len(ids) // 4
        self.fresh.append((doc_id, ids, n, min(context, n)))
        self.tokens += n

    def __len__(self) -> int:
        return len(self.named) + len(self.fresh)

    def _settle(self) -> None:
        """Take in new examples and forget those that are used up."""
        keep = np.flatnonzero(self.left)
        self.named = [self.named[k] for k in keep] + [f[:3] for f in self.fresh]
        self.left = np.concatenate((self.left[keep], np.array([f[2] for f in self.fresh], np.int64)))
        self.context = np.concatenate((self.context[keep], np.array([f[3] for f in self.fresh], np.int64)))
        self.fresh = []

    def sequences(self, until_tokens: int = 0, until_examples: int = 0) -> Iterator[list[tuple[int, int, int, int]]]:
        """Fill sequences until no more than so much waits: of each piece its example, start, length and loss-bearing tokens."""
        self._settle()
        waiting = len(self.named)
        while self.tokens and (self.tokens > until_tokens or waiting > until_examples):
            pieces = self._fill()
            yield pieces
            waiting -= sum(1 for k, *_ in pieces if not self.left[k])
        self._settle()

    def _take(self, k: int, n: int) -> tuple[int, int, int, int]:
        loss = max(0, n - int(self.context[k]))
        start = self.named[k][2] - int(self.left[k])
        self.left[k] -= n
        self.context[k] -= n - loss
        self.tokens -= n
        return k, start, n, loss

    def _fill(self) -> list[tuple[int, int, int, int]]:
        room, pieces = self.limits.copy(), []
        while room[0] and room[1]:
            most = np.minimum(np.minimum(self.left, int(room[0])), self.context + int(room[2]))
            if not most.any():
                break
            whole = (most == self.left) & (self.left > 0)
            if room[1] > 1 and whole.any():
                loss = np.maximum(self.left - self.context, 0)
                pull = self.pull * room
                score = self.left * pull[0] + pull[1] + loss * pull[2]
                k = int(np.where(whole, score, -1.0).argmax())
            else:  # cut the longest of those that fill most
                k = int(np.where(most == most.max(), self.left, -1).argmax())
            pieces.append(self._take(k, int(most[k])))
            room -= (pieces[-1][2], 1, pieces[-1][3])
        used = int(self.limits[0] - room[0])
        spare = used - (1 << used.bit_length() - 1)
        while spare:  # back to a power of two
            k, start, n, loss = pieces.pop()
            back = min(n, spare)
            free = n - loss
            kept = n - back
            self.left[k] += back
            self.context[k] += max(0, free - kept)
            self.tokens += back
            spare -= back
            if kept:
                pieces.append((k, start, kept, max(0, kept - free)))
        return pieces


def encoded(encoder: ByteEncoder, batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc_id, ids of the prompt and of the text of each row, encoded so much text at a time."""
    at = size = 0
    lengths = [len(t.as_buffer() or b"") + len(p.as_buffer() or b"") for t, p in zip(batch.column(1), batch.column(2), strict=True)]
    for k, n in enumerate(lengths):
        size += n
        if size < GROUP_BYTES and k + 1 < len(lengths):
            continue
        part = batch.slice(at, k + 1 - at)
        texts, prompts = ([(x or b"").decode("utf-8", "replace") for x in part.column(c).to_pylist()] for c in (1, 2))
        own = encoder.ids(texts + [p for p in prompts if p])
        before = iter(own[len(texts) :])
        yield from zip(part.column(0).to_pylist(), (next(before) if p else b"" for p in prompts), own, strict=False)
        at, size = k + 1, 0


def pack_examples(
    docs: DataFrame, vocab_path: str, capacity: int = 2048, max_segments: int = 16, max_loss: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 1.0),
) -> DataFrame:
    """Pack doc_id, text and, where there is such a column, prompt: one row per piece with its sequence and offset there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pool = encoder_of(vocab_path), Pool(capacity, max_segments, max_loss or capacity, weights)
        end, number = np.array([END_ID], dtype="<u4").tobytes(), TaskContext.get().partitionId() << SEQUENCE_BITS

        def rows(until_tokens: int = 0, until_examples: int = 0) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in range(8)]
            for pieces in pool.sequences(until_tokens, until_examples):
                offset = 0
                for k, start, n, loss in pieces:
                    doc_id, ids, tokens = pool.named[k]
                    crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                    for c, v in zip(cols, (doc_id, start, n, crc, tokens, number, offset, loss), strict=True):
                        c.append(v)
                    offset += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for doc_id, before, ids in encoded(encoder, batch):
                pool.add(doc_id, before + ids + end, len(before) // 4)
                if pool.tokens > POOL_TOKENS or len(pool) > POOL_EXAMPLES:
                    yield rows(POOL_TOKENS // 4, POOL_EXAMPLES // 4)
        yield rows()

    prompt = F.col("prompt") if "prompt" in docs.columns else F.lit(None)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), prompt.cast("binary").alias("prompt"))
    return chosen.mapInArrow(pack, PACKED)
