"""Token ids and counts by public tokenizers, through caches of pre-token results.

Both tokenizers decide a text piece by piece at spaces, so what they give for a piece can be kept and used again. Each class
says why its cutting changes nothing; texts to which that doesn't apply are given to the library whole. Texts are cut and their
different pieces found by Arrow, some megabytes at a time, so that Python looks at each different piece of a group once.
A worker process keeps its tokenizers and caches from task to task.
"""

from __future__ import annotations

import functools
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that a cache holds at most, and the longest piece it keeps: together they bound its memory.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48
#: Texts are cut in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Marks that are never joined to a letter before them, and letters that every Unicode version knows.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
WORD = re.compile(f"[{LETTERS}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """Pieces that were met, each with a number; when there are too many, those that no recent group had are forgotten."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.clock = entries, 0
        self.pieces, self.used = pa.array([], pa.string()), np.zeros(0, np.int64)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Their numbers; -1 for unknown ones."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False)
        self.used[at[at >= 0]] = self.clock
        return at

    def add(self, pieces: pa.Array) -> None:
        """These have the next numbers."""
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        # Long ones are the first to be forgotten
        short = pc.less_equal(pc.binary_length(pieces), CACHE_CHARS).to_numpy(zero_copy_only=False)
        self.used = np.concatenate((self.used, np.where(short, self.clock, -1)))

    def trim(self) -> np.ndarray | None:
        """After a group: the numbers that stay, which become 0 and so on; None if all do."""
        self.clock += 1
        if len(self.used) <= self.entries and not (self.used < 0).any():
            return None
        stay = np.flatnonzero(self.used >= 0)
        if len(stay) > self.entries // 2:
            stay = np.sort(stay[np.argsort(self.used[stay], kind="stable")[-(self.entries // 2) :]])
        self.pieces, self.used = self.pieces.take(pa.array(stay)), self.used[stay]
        return stay


def groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Nulls as empty texts, in groups of about GROUP_BYTES."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _different(pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each piece's number, and the different pieces."""
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _ends(lists: pa.Array) -> np.ndarray:
    """Where each list ends among all items, after a 0."""
    return np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin and are long as given, one after another."""
    ends = np.cumsum(size, dtype=np.int32)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


class WordIds:
    """Ids, as little-endian 32-bit integers, for the tokenizer with word ends.

    It drops white space and never joins what stands on either side of it, so a text's ids are those of its pieces in order.
    It lower-cases, so that A-Z can be lower-cased before the look-up (but where that might make a control string), and marks
    after a letter, apart from the apostrophe, are never joined to it, so that both can be looked up apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache = Recent()
        #: By number of a piece in the cache: whether it is a word of letters, and its ids' place among all.
        self.letters, self.begin, self.size = np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of these pieces. Words of letters are encoded together: each ends where a token with a word end does."""
        letters = np.fromiter((WORD.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        words = [p for p, x in zip(pieces, letters.tolist(), strict=True) if x]
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            words = [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        each = iter(words)
        return [next(each) if x else self.encode(p) for p, x in zip(pieces, letters.tolist(), strict=True)], letters

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        at = self.cache.find(pieces).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            pieces = pieces.take(pa.array(new))
            ids, letters = self.learn(pieces.to_pylist())
            at[new] = len(self.size) + np.arange(len(new))
            size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size, dtype=np.int32) - size))
            self.size, self.letters = np.concatenate((self.size, size)), np.concatenate((self.letters, letters))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), "<u4")))
            self.cache.add(pieces)
        return at

    def _trim(self) -> None:
        stay = self.cache.trim()
        if stay is not None:
            size, begin = self.size[stay], self.begin[stay]
            self.ids = self.ids[_spread(begin, size)]
            self.letters, self.size, self.begin = self.letters[stay], size, np.cumsum(size, dtype=np.int32) - size

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for group in groups(texts):
            lower = pc.if_else(pc.match_substring(group, "<|"), group, pc.ascii_lower(group))
            lists = pc.ascii_split_whitespace(lower)
            words = lists.flatten()
            bare = pc.ascii_rtrim(words, MARKS)
            marked = pc.not_equal(pc.binary_length(words), pc.binary_length(bare)).to_numpy(zero_copy_only=False)
            code, bare = _different(bare)
            first = self._numbers(bare)[code]
            odd = marked & ~self.letters[first]  # looked up with their marks
            code, pieces = _different(words.filter(pa.array(odd)))
            first[odd] = self._numbers(pieces)[code]
            marked &= ~odd
            code, marks = _different(pc.utf8_ltrim(words.filter(pa.array(marked)), LETTERS))
            marks = self._numbers(marks)[code]
            begin, size = np.zeros((len(words), 2), np.int32), np.zeros((len(words), 2), np.int32)
            begin[:, 0], size[:, 0] = self.begin[first], self.size[first]
            begin[marked, 1], size[marked, 1] = self.begin[marks], self.size[marks]
            every = self.ids[_spread(begin.ravel(), size.ravel())]
            stops = np.concatenate(([0], np.cumsum(size.sum(axis=1))))[_ends(lists)].tolist()
            self._trim()
            for i, j in zip(stops[:-1], stops[1:], strict=True):
                yield every[i:j]


class PieceCounts:
    """Counts for the byte-fallback piece model.

    Its pieces hold spaces at their start only (or nothing else), so no merge crosses a border between a non-space and a
    space; a line feed is a byte of its own. A piece of text is thus a run of spaces, without its first one, and what follows
    it; one that follows a line feed without a space keeps the line feed, for which the space that the library puts first is
    taken off again.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache, self.known = Recent(), np.zeros(0, np.int64)

    def lengths(self, pieces: pa.Array, frequent: Frequent | None = None) -> np.ndarray:
        """The number of tokens of each piece: from the table of frequent ones, the cache or the library."""
        out = frequent.find(pieces) if frequent else np.full(len(pieces), -1)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            pieces = pieces.take(pa.array(rest))
            at = self.cache.find(pieces).astype(np.int64)
            new = np.flatnonzero(at < 0)
            if len(new):
                pieces = pieces.take(pa.array(new))
                texts = pieces.to_pylist()
                n = np.array([len(t) - (p[0] == "\n") if p else 1 for p, t in zip(texts, self.model.encode(texts), strict=True)], np.int64)
                at[new] = len(self.known) + np.arange(len(new))
                self.known = np.concatenate((self.known, n))
                self.cache.add(pieces)
            out[rest] = self.known[at]
        return out

    def counts(self, texts: pa.Array, frequent: Frequent | None = None) -> np.ndarray:
        out = []
        for group in groups(texts):
            mine = np.zeros(len(group), np.int64)
            for where, lists in cut_pieces(group):
                code, pieces = _different(lists.flatten())
                mine[where] = np.diff(np.concatenate(([0], np.cumsum(self.lengths(pieces, frequent)[code])))[_ends(lists)])
            stay = self.cache.trim()
            if stay is not None:
                self.known = self.known[stay]
            whole = np.flatnonzero(_uncut(group))
            mine[whole] = [len(self.model.encode(group[int(k)].as_py())) for k in whole]
            out.append(mine)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class Frequent:
    """A table of frequent pieces and their numbers of tokens, small enough to be sent to every worker."""

    def __init__(self, lengths: dict[str, int]):
        self.pieces, self.lengths = pa.array(lengths.keys(), pa.string()), np.array(list(lengths.values()), np.int64)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """-1 for others."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False)
        return np.append(self.lengths, -1)[at]


def _uncut(texts: pa.Array) -> np.ndarray:
    """Texts with the mark that stands for a space in the model, or with a null character: to be counted whole."""
    return pc.or_(pc.match_substring(texts, "▁"), pc.match_substring(texts, "\0")).to_numpy(zero_copy_only=False)


def cut_pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(numbers of texts, a list of pieces for each): all but those that are empty or ``_uncut``. Runs of spaces take longer to cut."""
    runs = pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")).to_numpy(zero_copy_only=False)
    cut = ~_uncut(texts) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    plain, spaced = np.flatnonzero(cut & ~runs), np.flatnonzero(cut & runs)
    if len(plain):
        yield plain, pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
    if len(spaced):
        marked = pc.replace_substring_regex(pc.replace_substring(texts.take(pa.array(spaced)), "\n", "\0\n"), " ( *)", "\0\\1")
        # The library's own space before the text joins a run that follows it
        first = pc.if_else(pc.starts_with(marked, "\0"), pc.if_else(pc.starts_with(marked, "\0\n"), marked, pc.replace_substring(marked, "\0", " ", max_replacements=1)), marked)
        yield spaced, pc.split_pattern(first, "\0")


def frequent_pieces(batches: Iterable[pa.Array], keep: int) -> dict[str, int]:
    """About the commonest pieces of these texts, by a bounded counter.

    Of each group the 4 times ``keep`` commonest are counted; at 8 times ``keep`` entries, all counts fall by the median.
    """
    counts: Counter[str] = Counter()
    for texts in batches:
        for group in groups(texts):
            for _, lists in cut_pieces(group):
                found = pc.value_counts(lists.flatten())
                found = found.filter(pc.less_equal(pc.utf8_length(found.field(0)), CACHE_CHARS))
                n = found.field(1).to_numpy(zero_copy_only=False)
                some = np.argsort(-n, kind="stable")[: 4 * keep]
                for p, k in zip(found.field(0).take(pa.array(some)).to_pylist(), n[some].tolist(), strict=True):
                    counts[p] += k
            if len(counts) > 8 * keep:
                least = sorted(counts.values(), reverse=True)[4 * keep]
                counts = Counter({p: n - least for p, n in counts.items() if n > least})
    return dict(counts.most_common(keep))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """This process's own."""
    return WordIds(path)


@functools.lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    """This process's own."""
    return PieceCounts(path)
