"""Token ids of whole texts from the ids of their words, each distinct word encoded once per worker.

Arrow cuts and numbers the words of a batch, a bounded memo holds the ids of words met before, and NumPy joins the runs.
The ids are those of encoding each whole text only where the tokenizer has token boundaries at the cuts; ``cut`` names
the kind of tokenizer:

``blanks``: white space is dropped and never joined across; words are what ASCII white space separates.
``spaces``: byte-level with a space in front of the word that follows it; a space before a visible character always
starts a token. Texts with other spaces (two in a row, before a line end, at the end) are encoded whole.
``whole``: any tokenizer; nothing is cut.

Words are also cut before a mark that follows an ASCII letter or digit, and ASCII capitals become small, where trials show
that the tokenizer cuts or does the same. Texts that hold one of its added tokens are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words whose ids a worker remembers, before those of a batch; beyond it the half goes that came up in the fewest batches.
MEMO_WORDS = 400_000
# Bytes of those words; beyond it all go, as words so long seldom come again.
MEMO_BYTES = 32 << 20
# Texts are worked on in batches of about so many bytes; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
# Texts that are encoded whole are handed to the tokenizer about so many bytes at a time, as it returns far more than ids.
WHOLE_BYTES = 1 << 18


def _visible(char: str) -> bool:
    """A character that neither side takes for a space: printable ASCII and letters of the Latin to Cyrillic blocks."""
    return "!" <= char <= "~" or "¡" <= char <= "ԯ"


# Marks that end a word, what they have to follow, and the character that stands for a cut.
_MARKS, _BEFORE, _CUT = ".,;:!?", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "\x00"
_MARKED = f"([A-Za-z0-9])([{_MARKS}])"
# New words are handed to the tokenizer so many at a time, as one text with an added token between them.
_JOINED = 1024


class WordEncoder:
    """Encodes string arrays with a tokenizer file into counts per text and one run of ids."""

    def __init__(self, path: str, cut: str) -> None:
        from tokenizers import Tokenizer
        if cut not in ("blanks", "spaces", "whole"):
            raise ValueError(f"unknown cut {cut}")
        self.tokenizer, self.cut = Tokenizer.from_file(path), cut
        self.id_bytes = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.between = next(((i, t.content) for i, t in added.items()
                             if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        small = _BEFORE.swapcase()
        self.small = cut == "blanks" and self._direct([small, *small]) == self._direct([small.lower(), *small.lower()])
        trials = [(f"x{a}", f"{m}") for a in _BEFORE for m in _MARKS] + [(a, m) for a in _BEFORE for m in _MARKS]
        apart = self._direct([x for pair in trials for x in pair])
        self.marks = [a + b for a, b in zip(apart[::2], apart[1::2])] == self._direct([a + b for a, b in trials])
        self._clear()

    def _clear(self) -> None:
        # Words by number, as one Arrow array: a few bytes a word beside its letters.
        self.memo = pa.array([], pa.string())
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.uint32)
        self.pool = np.zeros(0, np.uint32)

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of words without added tokens."""
        if not self.between:
            found = self._direct(words)
            return np.array([len(x) for x in found], np.int64), np.fromiter((i for x in found for i in x), np.uint32)
        mark, text = self.between
        ids = np.concatenate([np.array(self._direct([text.join(words[i:i + _JOINED]) + text])[0], np.uint32)
                              for i in range(0, len(words), _JOINED)])
        ends = np.flatnonzero(ids == mark)
        return np.diff(ends, prepend=-1) - 1, np.delete(ids, ends)

    def _shrink(self) -> None:
        """Keep the half of the memo's bound that came up in the most batches, of equal ones the newer; old batches count half."""
        if self.memo.nbytes > MEMO_BYTES:
            return self._clear()
        order = np.lexsort((np.arange(len(self.used)), self.used))
        kept = np.sort(order[max(0, len(order) - MEMO_WORDS // 2):])
        pool = self._gather(kept)
        self.lengths = self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.memo = self.memo.take(pa.array(kept))
        self.pool, self.used = pool, self.used[kept] >> 1

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words by number, one run after another."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        return self.pool[shift + np.arange(len(shift))]

    def _learn(self, words: pa.Array) -> None:
        """Number words that the memo doesn't hold and keep their ids."""
        lengths, ids = self._words(words.to_pylist())
        starts = len(self.pool) + np.cumsum(lengths) - lengths
        self.pool = np.concatenate([self.pool, ids])
        self.lengths, self.starts = np.concatenate([self.lengths, lengths]), np.concatenate([self.starts, starts])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.uint32)])
        self.memo = pa.concat_arrays([self.memo, words])

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text."""
        if self.cut == "blanks":
            texts = pc.replace_substring_regex(texts, _MARKED, r"\1 \2") if self.marks else texts
            return pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.small else texts)
        texts = pc.replace_substring_regex(texts, _MARKED, rf"\1{_CUT}\2") if self.marks else texts
        return pc.split_pattern(pc.replace_substring(texts, " ", f"{_CUT} "), _CUT)

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Texts that must not be cut because they hold an added token or the character that marks cuts."""
        whole = np.zeros(len(texts), bool)
        for part in [*self.added, _CUT]:
            whole |= pc.match_substring(texts, part, ignore_case=part != _CUT).to_numpy(zero_copy_only=False)
        return whole

    def _uncut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of texts encoded whole."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for part in batches_of_bytes([pa.RecordBatch.from_arrays([texts], names=["text"])], 0, WHOLE_BYTES):
            found = self._direct(part.column(0).to_pylist())
            counts.append(np.array([len(x) for x in found], np.int64))
            ids += [np.array(x, np.uint32) for x in found]
        return np.concatenate(counts), np.concatenate(ids)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and ids of texts that may be cut, and which texts may not; if there are any, the rest is empty."""
        if len(self.memo) > MEMO_WORDS or self.memo.nbytes > MEMO_BYTES:
            self._shrink()
        split = self._split(texts)
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        distinct, places = coded.dictionary, coded.indices.to_numpy()
        found = pc.index_in(distinct, value_set=self.memo)
        numbers = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = numbers < 0
        new = distinct.filter(pa.array(unknown))
        if self.cut == "spaces":
            # The memo holds no odd word: texts with one are never numbered.
            odd = unknown.copy()
            odd[unknown] = [w[:1] == " " and not _visible(w[1:2]) for w in new.to_pylist()]
            if odd.any():
                uncut = np.diff(np.concatenate([[0], np.cumsum(odd[places])])[offsets]) > 0
                return np.zeros(0, np.int64), np.zeros(0, np.uint32), uncut
        if len(new):
            numbers[unknown] = len(self.memo) + np.arange(len(new))
            self._learn(new)
        self.used[numbers] += 1
        numbers = numbers[places]
        ends = np.concatenate([[0], np.cumsum(self.lengths[numbers])])[offsets]
        return np.diff(ends), self._gather(numbers), np.zeros(len(texts), bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids per text and all ids in order, as unsigned 32-bit numbers; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        whole = np.ones(len(texts), bool)
        if self.cut != "whole":
            whole = self._whole(texts)
            rest = texts.filter(pa.array(~whole)) if whole.any() else texts
            if len(rest):
                counts, ids, uncut = self._by_words(rest)
                if not whole.any() and not uncut.any():
                    return counts, ids
                whole[np.flatnonzero(~whole)[uncut]] = True
        counts = np.zeros(len(texts), np.int64)
        counts[whole], direct = self._uncut(texts.filter(pa.array(whole)))
        rest = np.zeros(0, np.uint32)
        if not whole.all():
            counts[~whole], rest, _ = self._by_words(texts.filter(pa.array(~whole)))
        ids = np.zeros(int(counts.sum()), np.uint32)
        from_whole = np.repeat(whole, counts)
        ids[from_whole] = direct
        ids[~from_whole] = rest
        return counts, ids


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id behind each text."""
    return counts + 1, np.insert(ids, np.cumsum(counts), np.uint32(end_id))


def batches_of_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, cut and joined so that a string column holds about ``most`` bytes in each."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(lengths, before + most - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(lengths[stop - 1]) - before
            before, start = int(lengths[stop - 1]), stop
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            elif start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
