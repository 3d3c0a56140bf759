"""Tokenisers inside executors: one per Python worker, with a bounded memory of encoded pieces.

A text is cut at places that no pre-token of the tokeniser can span. Arrow cuts a batch of texts into pieces and numbers the distinct ones; each of those
is encoded by the library once, and the ids of the batch are gathered by number. What a worker remembers is bounded in
entries of at most KEPT_CHARS characters, two generations of KEPT, so pieces used of late stay, and is given back at the end of each
task; ids are the same with or without it.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in a generation, about 200 bytes each, and the longest that are kept.
KEPT, KEPT_CHARS = 200_000, 48

#: Characters and texts of a batch that is encoded together, about.
BATCH = (1 << 22, 4096)

#: The one letter that falls to a letter and a mark.
DOTTED = "\u0130"

_workers: dict[tuple, object] = {}


class Pieces:
    """Ids of pieces, by `learn`: the ids of one piece as an iterable of integers. `tails` are marks that are a pre-token of their own after a
    letter at the end of a piece, with their ids, so only the piece without is encoded and remembered. Not after DOTTED, where the mark would be joined."""

    def __init__(self, learn: Callable[[str], list[int]], tails: dict[str, list[int]] | None = None, size: int = KEPT):
        self.learn, self.size = learn, size
        self.tails = {c: array("I", ids).tobytes() for c, ids in (tails or {}).items()}
        self.clear()

    def clear(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        young, old, learn, limit, tails = self.young, self.old, self.learn, KEPT_CHARS, self.tails
        out = list(map(young.get, pieces))
        for i in [i for i, v in enumerate(out) if v is None]:
            k, tail = pieces[i], b""
            if k[-1:] in tails and (c := k[-2:-1]).isalpha() and c != DOTTED:
                k, tail = k[:-1], tails[k[-1]]
            v = young.get(k) if tail else None
            if v is None:
                v = old.get(k)
                if v is None:
                    v = array("I", learn(k)).tobytes()
                if len(k) <= limit:
                    young[k] = v
            out[i] = v + tail
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out


def _strings(x: pa.Array) -> list[str]:
    """A string array as a list; by one join, which is faster, where no string holds the character between."""
    if not len(x):
        return []
    out = pc.binary_join(pa.LargeListArray.from_arrays([0, len(x)], x), pa.scalar("\x1f", x.type))[0].as_py().split("\x1f")
    return out if len(out) == len(x) else x.to_pylist()


class Encoder:
    """Ids of texts. `cut` gives, for a batch, the pieces in order (a string array), whether each stands at a start (not after one space), and
    how many each text has."""

    def __init__(self, cut: Callable, inner: Pieces, first: Pieces | None = None):
        self.cut, self.inner, self.first = cut, inner, first or inner

    def clear(self) -> None:
        self.inner.clear()
        self.first.clear()

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32 bits."""
        out: list[np.ndarray] = []
        if not texts:
            return out
        pieces, at_start, counts = self.cut(texts)
        coded = pieces.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        words = _strings(coded.dictionary)
        if at_start is not None and at_start.any():
            # the pieces at a start get numbers of their own
            starts, which = np.unique(number[at_start], return_inverse=True)
            inside = np.zeros(len(words), dtype=bool)
            inside[number[~at_start]] = True
            own = np.cumsum(inside) - 1
            known = self.inner.ids([w for w, k in zip(words, inside.tolist(), strict=True) if k])
            known += self.first.ids([words[i] for i in starts.tolist()])
            number = own[number]
            number[at_start] = len(known) - len(starts) + which
        else:
            known = self.inner.ids(words)
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        table = np.empty(len(known), dtype=object)
        table[:] = known
        ids = np.frombuffer(b"".join(table[number].tolist()), dtype="<u4")
        ends = np.concatenate([[0], np.cumsum(sizes[number])])
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [x.astype("<u4").tobytes() for x in self.arrays(texts)]


#: White space; a space or line end beside another of these is a run. Python's own set, which holds all that tokenisers use.
_WHITE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace()) + "]"
_RUN = f"^{_WHITE}|{_WHITE}[ \\n]|[ \\n]{_WHITE}"
#: Places before a single space that stands between two other characters.
_SINGLE = re.compile(r"(?<=\S)(?= \S)")


def _runs(text: str) -> tuple[list[str], list[bool]]:
    """Pieces of a text with runs of white space: one that begins with a single space goes without it, others are at a start."""
    parts = _SINGLE.split(text)
    inner = [p[0] == " " and p[1:2] not in ("", " ") and not p[1].isspace() for p in parts]
    return [p[1:] if k else p for p, k in zip(parts, inner, strict=True)], [not k for k in inner]


def cut_byte_level(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces for byte-level BPE with the usual pattern (an optional space before each word).

    No pre-token spans a place before white space that follows another character, and a pre-token that begins at the only
    white space between two words depends on nothing before it (a lone line end is one itself): cutting there is safe.
    """
    whole = pa.array(texts, pa.large_string())
    odd = pc.match_substring_regex(whole, _RUN).to_numpy(zero_copy_only=False) | np.array([not t for t in texts])
    lists = pc.split_pattern(pc.replace_substring(whole.filter(pa.array(~odd)), "\n", " \n "), " ")
    pieces = lists.flatten()
    even_counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    line = pc.equal(pieces, "\n").to_numpy(zero_copy_only=False)
    start = line.copy()
    start[1:] |= line[:-1]
    start[np.cumsum(even_counts) - even_counts] = True
    counts = np.zeros(len(texts), dtype=np.int64)
    counts[~odd] = even_counts
    if odd.any():
        cut = [_runs(texts[i]) if texts[i] else ([], []) for i in np.flatnonzero(odd).tolist()]
        counts[odd] = [len(p) for p, _ in cut]
        text_of = np.repeat(np.arange(len(texts)), counts)
        all_pieces = pa.concat_arrays([pieces, pa.array([p for ps, _ in cut for p in ps], pa.large_string())])
        all_starts = np.concatenate([start, np.array([k for _, ks in cut for k in ks], dtype=bool)])
        place = np.zeros(len(text_of), dtype=np.int64)
        is_odd = odd[text_of]
        place[~is_odd] = np.arange(len(pieces))
        place[is_odd] = len(pieces) + np.arange(int(is_odd.sum()))
        pieces, start = all_pieces.take(pa.array(place)), all_starts[place]
    return pieces, start, counts


def cut_white_space(texts: list[str]) -> tuple[pa.Array, None, np.ndarray]:
    """Pieces for tokenisers that drop white space (no pre-token holds any) and case, of which A to Z fall here. An empty piece has no ids."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    return lists.flatten(), None, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


#: A word of letters and what follows from the first ASCII mark on: letters end a pre-token there, and the rest depends on nothing before it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{1,48})([!-/:-@\[-`{-~][\s\S]*)?")
#: Bytes as characters in byte-level vocabularies: printable Latin-1 as itself, the others in order from U+0100.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = str.maketrans({b: chr(b) if b in _SHOWN else chr(256 + b - sum(s < b for s in _SHOWN)) for b in range(256)})


def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def _tails(t) -> dict[str, list[int]]:
    return {c: t.encode(c, add_special_tokens=False).ids for c in ",."}


def _learner(t, lead: str, shown: str, lower: bool) -> Callable:
    """Ids of a piece that stands after `lead`: of plain words straight from the library's BPE model, past its pre-tokeniser, where `shown`
    stands for `lead`; of others, and of what follows a plain word, by the library."""
    tokenize, fullmatch = t.model.tokenize, _PLAIN.fullmatch
    whole = lambda s: t.encode(s, add_special_tokens=False).ids
    rests: dict[str, list[int]] = {}

    tails = _tails(t)

    def learn(piece: str) -> list[int]:
        if piece.isascii():
            if piece.isalpha():
                return [x.id for x in tokenize(shown + (piece.lower() if lower else piece))]
            stem = piece[:-1]
            if stem.isalpha() and piece[-1] in tails:
                return [x.id for x in tokenize(shown + (stem.lower() if lower else stem))] + tails[piece[-1]]
        m = fullmatch(piece)
        if m is None:
            return whole(lead + piece)
        stem, rest = m[1].lower() if lower else m[1], m[2]
        ids = [x.id for x in tokenize(shown + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(_ALPHABET)))]
        if rest:
            more = rests.get(rest)
            if more is None:
                if len(rests) > 10_000:
                    rests.clear()
                more = whole(rest)
                if len(rest) <= KEPT_CHARS:
                    rests[rest] = more
            ids = ids + more
        return ids

    return learn


def give_back(encoder: Encoder | None = None) -> None:
    """At the end of a task: what the encoder remembers, and memory that the allocators hold for nothing, goes back to the machine. Workers are
    used again, also by stages that need the memory elsewhere."""
    if encoder:
        encoder.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _held(key: tuple, make: Callable):
    if key not in _workers:
        _workers[key] = make()
    return _workers[key]


def word_encoder(path: str) -> Encoder:
    """The tokenizers library, for a lower-casing vocabulary, on white-space separated pieces."""

    def make() -> Encoder:
        t = _library(path)
        return Encoder(cut_white_space, Pieces(_learner(t, "", "", True), _tails(t)))

    return _held(("word", path), make)


def byte_encoder(path: str) -> Encoder:
    """The tokenizers library on pieces of byte-level BPE."""

    def make() -> Encoder:
        t = _library(path)
        return Encoder(cut_byte_level, Pieces(_learner(t, " ", "\u0120", False), _tails(t)), Pieces(_learner(t, "", "", False), _tails(t)))

    return _held(("byte", path), make)


def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding from a local rank file, without special tokens."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return _held(("rank", path, pattern), make)


def rank_encoder(path: str, pattern: str) -> Encoder:
    e = rank_encoding(path, pattern)
    return _held(("rank encoder", path, pattern), lambda: Encoder(cut_byte_level, Pieces(lambda p: e.encode_ordinary(" " + p)), Pieces(e.encode_ordinary)))


def slices(batches, columns: list[str], chars: int = 1 << 21, rows: int = 512):
    """Python lists of `columns` from Arrow batches, cut so that a slice holds about `chars` characters at most.

    The last column is the text.
    """
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)) for c in columns]
        size = 0
        begin = 0
        lengths = [len(x) if x is not None else 0 for x in cols[-1].to_pylist()]
        for i, n in enumerate(lengths):
            size += n
            if size >= chars or i + 1 - begin >= rows:
                yield [c.slice(begin, i + 1 - begin).to_pylist() for c in cols]
                begin, size = i + 1, 0
        if begin < len(lengths):
            yield [c.slice(begin).to_pylist() for c in cols]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))
