"""Token ids of whole texts by a tokenizer file, for use inside Spark tasks.

Most of the time of byte-level BPE goes into words that occur again and again. ``Encoder`` cuts texts before spaces,
where byte-level pre-tokenizers always cut too, finds the distinct pieces of a batch with Arrow, lets the tokenizer
encode each of them once, and puts the ids of the texts together with array operations. Every id comes from the
tokenizer; the ids equal those of the whole text.

A space is a safe place to cut when a visible character follows it or stands before it: the pattern of these
tokenizers joins one space to the visible characters after it and never joins a visible character to a space after
it. Other spaces stay inside their piece. A single line break between visible characters is a safe place too.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

END_OF_DOCUMENT = 0
#: Text whose distinct pieces are looked for at once.
BATCH_BYTES = 8_000_000
#: Words and whole pieces, with the signs at their ends, that are kept with their ids from batch to batch, about 40 bytes
#: each. Beyond, those stay that were met in the last few batches: rare ones come and go.
KEPT = 500_000
KEPT_BATCHES = 3
PIECES_A_STRING = 2000
ENDS = ".,"
_CUT, _MARK = "\0", "\1"

_UNSAFE = re.compile(r" (?!\S)")
_SAFE = re.compile(r" (?=\S)")
_SPACE = re.compile(r"\s")
_MORE_LINES = re.compile(r"\n(?!\S)|\s\n")
#: White space but for spaces and line breaks: of ASCII, of Latin-1, and the rest.
_RARE = tuple("\t\x0b\x0c\r\x1c\x1d\x1e\x1f"), tuple("\x85\xa0"), tuple(
    chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def _letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: visible Latin-1 characters stand for themselves, others for the next free letters."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_AS_LETTERS = _letters()
_HIDDEN = re.compile("[" + "".join(re.escape(chr(b)) for b in _AS_LETTERS if b >= 0x7F) + "]")


def _as_letters(text: str) -> str:
    """The bytes of a text without control characters but line breaks, as letters."""
    written = text.encode().decode("latin-1")
    if not text.isascii():
        written = _HIDDEN.sub(lambda m: _AS_LETTERS[ord(m[0])], written)
    return written.replace(" ", _AS_LETTERS[0x20]).replace("\n", _AS_LETTERS[0x0A])


def _layout(text: str) -> tuple[bool, bool]:
    """(a space that is no safe place to cut, a line break that is none) is somewhere in a text."""
    if any(c in text for c in _RARE[0]) or not text.isascii() and any(c in text for group in _RARE[1:] for c in group):
        return _UNSAFE.search(text) is not None, _MORE_LINES.search(text) is not None
    both = " \n" in text
    return both or "  " in text or text[-1] == " ", both or "\n\n" in text or "\n " in text or text[-1] == "\n"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _places(asked: pa.Array, held: pa.Array) -> np.ndarray:
    """Where distinct strings stand among other distinct strings, -1 if they do not: the shorter list is made a table."""
    if len(held) <= len(asked):
        return pc.fill_null(pc.index_in(asked, value_set=held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.fill_null(pc.index_in(held, value_set=asked), -1).to_numpy(zero_copy_only=False)
    both = np.flatnonzero(there >= 0)
    out = np.full(len(asked), -1, np.int64)
    out[there[both]] = both
    return out


def _strings(pieces: pa.Array) -> list[str]:
    """Strings without cuts as a list: one string that is split takes a tenth of the time of ``to_pylist``."""
    if not len(pieces) or pieces.nbytes >> 30:  # strings of a plain list have 31 bits of place
        return pieces.to_pylist()
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces.cast(pa.string()))
    return pc.binary_join(whole, _CUT)[0].as_py().split(_CUT)


class Known:
    """Ids of pieces that were met before."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode, self.batch = encode, 0
        self.pieces = pa.array([], pa.large_string())
        self.ids = np.empty(0, np.uint32)
        self.sizes = self.met = np.empty(0, np.int64)

    def find(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): where the ids of each of some distinct pieces stand; only new ones are encoded."""
        self.batch += 1
        found = _places(pieces, self.pieces)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = pieces.take(pa.array(new))
            found[new] = len(self.pieces) + np.arange(len(new))
            more, sizes = self.encode(_strings(fresh))
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.ids, self.sizes = np.concatenate([self.ids, more]), np.concatenate([self.sizes, sizes])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[found] = self.batch
        ids, starts = self.ids, np.cumsum(self.sizes) - self.sizes
        own = starts[found], self.sizes[found]
        if len(self.pieces) > KEPT:
            kept = np.flatnonzero(self.met > self.batch - KEPT_BATCHES)
            if len(kept) > KEPT:
                kept = np.flatnonzero(self.met == self.batch)
            self.pieces = self.pieces.take(pa.array(kept))
            self.ids = ids[_spread(starts[kept], self.sizes[kept])]
            self.sizes, self.met = self.sizes[kept], self.met[kept]
        return ids, *own


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Names of special tokens inside a text are ordinary text. A null text has no ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        line = self._ids([" a\n b", " a", "\n", " b"])
        #: Id of a line break, if it stands alone between two pieces.
        self.line = line[2][0] if len(line[2]) == 1 and line[0] == line[1] + line[2] + line[3] else None
        self.words, self.bare_words, self.begins = self._words(path)
        self.known_words = Known(lambda words: self._pieces(words, " "))
        self.known = Known(self._distinct)
        #: Ids of signs that end a word; they are apart from its letters.
        self.ends = {c: ids[0] for c, ids in zip(ENDS, self._ids(list(ENDS)))} if self.words is not None else {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, path: str):
        """The model behind splitters that only look for line breaks, for pieces that are single words.

        Byte-level tokenizers write bytes as letters; a word of letters, with the space before it, is never cut by their
        pattern, so it can go to the model directly. The model keeps no words of its own: they come once a batch. With
        the two forms, one that drops line breaks and one that keeps them, comes which ids begin with a space.
        """
        from tokenizers import Tokenizer, models, pre_tokenizers

        if self.line is None or type(self.tokenizer.pre_tokenizer) is not pre_tokenizers.ByteLevel or self.tokenizer.normalizer:
            return None, None, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)["model"]
        plain = {k: v for k, v in spec.items() if v is not None and k not in ("type", "vocab", "merges")}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["merges"]]
        model = models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0, **plain)
        dropping, keeping = Tokenizer(model), Tokenizer(model)
        dropping.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_AS_LETTERS[ord("\n")])
        keeping.pre_tokenizer = pre_tokenizers.Split(_AS_LETTERS[ord("\n")], "isolated")
        begins = np.zeros(max(spec["vocab"].values()) + 1, bool)
        begins[[i for token, i in spec["vocab"].items() if token[0] == _AS_LETTERS[ord(" ")]]] = True
        return dropping, keeping, begins

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        found = self._ids(texts)
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(x) for x in found], np.int64)

    def _joined(self, pieces: list[str], lead: str, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_each`` for pieces without white space, with ``lead`` before each; many share a string, a line break
        between two."""
        groups = [pieces[i : i + PIECES_A_STRING] for i in range(0, len(pieces), PIECES_A_STRING)]
        strings = [lead + ("\n" + lead).join(group) for group in groups]
        if plain:
            strings = [_as_letters(x) for x in strings]
        flat, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        if plain and lead:  # every word begins with an id that begins with a space, and no other id does
            for done in self.words.encode_batch_fast(strings, add_special_tokens=False):
                ids = np.array(done.ids, np.uint32)
                flat.append(ids)
                sizes.append(np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids))))
            return np.concatenate(flat), np.concatenate(sizes)
        for done in (self.bare_words if plain else self.tokenizer).encode_batch_fast(strings, add_special_tokens=False):
            ids = np.array(done.ids, np.uint32)
            breaks = ids == self.line
            flat.append(ids[~breaks])
            sizes.append(np.diff(np.flatnonzero(np.concatenate([[True], breaks, [True]]))) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _pieces(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_each`` for any distinct pieces, with ``lead`` before each."""
        if self.line is None:
            return self._each([lead + p for p in pieces])
        groups: list[list[int]] = [[], [], []]  # words, broken pieces, others
        for i, p in enumerate(pieces):
            groups[0 if self.words is not None and p.isalpha() else 1 if not p or _SPACE.search(p) else 2].append(i)
        parts = [[pieces[i] for i in group] for group in groups]
        done = [
            self._joined(parts[0], lead, True),
            self._each([lead + p if p else "" for p in parts[1]]),
            self._joined(parts[2], lead, False),
        ]
        sizes = np.zeros(len(pieces), np.int64)
        order = np.concatenate([np.array(group, np.int64) for group in groups])
        sizes[order] = given = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[0] for d in done])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(given) - given
        return flat[_spread(starts, sizes)], sizes

    def _distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct pieces of a batch and how many each has.

        A piece has a space before it, but for those that begin with a mark or a line break. Words with and without a
        sign at their end share their ids.
        """
        with_space: dict[str, int] = {}
        without: dict[str, int] = {}
        n = len(pieces)
        stem, bare = np.zeros(n, np.int64), np.zeros(n, bool)
        line, end = np.zeros(n, bool), np.zeros(n, np.int64)
        for i, p in enumerate(pieces):
            names = with_space
            if p[:1] == _MARK or p[:1] == "\n" and len(p) > 1:
                names, bare[i], line[i], p = without, True, p[0] == "\n", p[1:]
            elif p == "\n":
                names, bare[i] = without, True
            if p[-1:] in self.ends and p[:-1].isalpha():
                end[i], p = self.ends[p[-1]] + 1, p[:-1]
            stem[i] = names.setdefault(p, len(names))
        flat, starts, sizes = self.known_words.find(pa.array(list(with_space), pa.large_string()))
        more, more_sizes = self._pieces(list(without), "")
        starts = np.concatenate([starts, len(flat) + np.cumsum(more_sizes) - more_sizes])
        flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, more_sizes])
        stem[bare] += len(with_space)
        inner = sizes[stem]
        whole = inner + line + (end > 0)
        at = np.cumsum(whole) - whole
        out = np.empty(int(whole.sum()), np.uint32)
        if line.any():
            out[at[line]] = self.line
        out[_spread(at + line, inner)] = flat[_spread(starts[stem], inner)]
        closed = end > 0
        out[(at + whole - 1)[closed]] = end[closed] - 1
        return out, whole

    def _batch(self, texts: Sequence[str | None]) -> list[bytes]:
        joined, direct = [], {}
        for i, text in enumerate(texts):
            if not text:
                text = ""
            elif _MARK in text or _CUT in text:
                direct[i] = text
                text = ""
            else:
                unsafe, more_lines = _layout(text)
                if unsafe:
                    text = _CUT.join(_SAFE.split(text))
                elif self.line is None or more_lines:
                    text = text.replace(" ", _CUT)
                else:  # a line break stays with the word after it
                    text = text.replace("\n", " \n").replace(" ", _CUT)
            joined.append(_MARK + text)  # the first piece has no space before it
        lists = pc.split_pattern(pa.array(joined, pa.large_string()), _CUT)
        coded = lists.flatten().dictionary_encode()
        ids, starts, sizes = self.known.find(coded.dictionary)
        index = coded.indices.to_numpy()
        lengths = sizes[index]
        data = ids[_spread(starts[index], lengths)].astype("<u4", copy=False).tobytes()
        edges = (np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy()] * 4).tolist()
        out = [data[a:b] for a, b in zip(edges[:-1], edges[1:])]
        for i, own in zip(direct, self._ids(list(direct.values()))):
            out[i] = np.array(own, "<u4").tobytes()
        return out

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text, as bytes."""
        out: list[bytes] = []
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size > BATCH_BYTES or i == len(texts) - 1:
                out += self._batch(texts[first : i + 1])
                first, size = i + 1, 0
        return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given sizes, one run after the other."""
    before = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    kind = np.int32 if total < 1 << 31 else np.int64
    out = np.repeat((starts - before).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker, kept between tasks with the pieces it knows."""
    kept = worker_state().setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
