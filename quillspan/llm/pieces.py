"""Cutting texts into pieces that tokenizers treat independently, so that each distinct piece is encoded once.

Byte-level vocabularies first split a text by ``public_tokenizers.PATTERN`` and never merge across a split.
In that pattern a blank opens a match only before a non-space and a line feed between two non-spaces is a match
of its own.  A text whose only white space is single blanks and single line feeds between non-spaces can
therefore be cut at those places by plain string methods.  Any other text is cut by the pattern itself.

The word vocabulary drops white space and never looks across it: a text's ids are those of its ASCII-space-free
chunks, one after another.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable
from itertools import chain

from .words import text_bytes

#: Bytes that a cache may take in a worker process, and what an entry takes beside its strings; a full cache starts
#: anew.  It bounds memory and never changes a result.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 200
_MARK, _WHOLE = "\x00", "\x01"
_SPACE = re.compile(r"\s")


class PieceCache:
    """Maps pieces to encoded bytes; ``encode`` turns a list of unseen pieces into their bytes."""

    def __init__(self, encode: Callable[[list], list[bytes]], limit: int = CACHE_BYTES):
        self.encode, self.limit, self.known, self.size = encode, limit, {}, 0

    def add(self, pieces: Iterable) -> None:
        wanted = set(pieces)
        fresh = [p for p in wanted if p not in self.known]
        if not fresh:
            return
        more = sum(map(len, fresh)) * 2 + ENTRY_BYTES * len(fresh)
        if self.size + more > self.limit:
            self.known.clear()
            fresh = list(wanted)
            self.size, more = 0, sum(map(len, fresh)) * 2 + ENTRY_BYTES * len(fresh)
        self.size += more
        self.known.update(zip(fresh, self.encode(fresh)))


class Known(dict):
    """What ``make`` gives for each key, made when it is first looked up.

    When half of ``limit`` is taken, what is held becomes the old half, and the former old half goes: keys that are met
    again move back, rare ones leave.
    """

    def __init__(self, make: Callable, limit: int = CACHE_BYTES):
        self.make, self.limit, self.size, self.old = make, limit // 2, 0, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.size += 2 * len(key) + ENTRY_BYTES
        if self.size > self.limit:
            self.old = self.copy()
            self.clear()
            self.size = 2 * len(key) + ENTRY_BYTES
        self[key] = found
        return found


class NeedsPattern(Exception):
    """A piece has white space of its own: only the pattern cuts its text rightly."""


def cut_level(text: str) -> list[str] | None:
    """``text`` cut at single blanks and line feeds, or None if it has other characters that need the pattern.

    A cut piece is a line feed, or a text that stood after a blank, or one marked as standing after none.
    """
    if _MARK in text or _WHOLE in text:
        return None
    cut = f"{_MARK}{text}".replace("\n", f" \n {_MARK}").split(" ")
    return None if "" in cut or _MARK in cut else cut


def piece_text(piece: str) -> str:
    """The characters that a cut piece or a whole match stands for."""
    return piece if piece == "\n" else piece[1:] if piece[0] in (_MARK, _WHOLE) else f" {piece}"


def is_plain(piece: str) -> bool:
    """Whether a cut piece holds no white space of its own; the plain cut is right for such pieces only."""
    return piece == "\n" or not _SPACE.search(piece)


class LevelEncoder:
    """Encodes texts for a byte-level vocabulary, each distinct piece once as long as the cache holds it.

    ``find_all`` gives the pattern's matches in a text; ``encode`` maps piece texts to the bytes of their ids.
    """

    def __init__(self, find_all: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_BYTES):
        self.find_all = find_all
        self.cache = PieceCache(lambda pieces: self._encode(pieces, encode), limit)

    def _encode(self, pieces: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes | None]:
        words = [self._words(p) for p in pieces]
        distinct = list({w for found in words if found for w in found})
        ids = dict(zip(distinct, encode(distinct)))
        return [None if found is None else b"".join([ids[w] for w in found]) for found in words]

    def _words(self, piece: str) -> list[str] | None:
        """The matches of a piece; letters alone, and letters before one mark, are known without the pattern."""
        if piece.isalpha():
            return [f" {piece}"]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [f" {piece[:-1]}", piece[-1]]
        return self.find_all(piece_text(piece)) if piece[0] == _WHOLE or is_plain(piece) else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        cuts = [cut_level(t) if t else [] for t in texts]
        if sum(map(len, texts)) > 4_000_000 and len(texts) > 1:  # one part's pieces must fit in the cache
            half = len(texts) // 2
            return self(texts[:half]) + self(texts[half:])
        self.cache.add(chain.from_iterable(cut for cut in cuts if cut))
        known, out = self.cache.known, [None] * len(texts)
        for i, cut in enumerate(cuts):
            if cut is not None:
                try:
                    out[i] = b"".join(map(known.__getitem__, cut))
                except TypeError:  # a piece with white space of its own
                    pass
        rest = [i for i, ids in enumerate(out) if ids is None]
        whole = {i: [_WHOLE + m for m in self.find_all(texts[i])] for i in rest}
        self.cache.add(m for ms in whole.values() for m in ms)
        for i, ms in whole.items():
            out[i] = b"".join(map(self.cache.known.__getitem__, ms))
        return out


class PieceIds:
    """Encodes texts for a byte-level vocabulary of the tokenizers library, whose ``model`` encodes each distinct match.

    ``find_all`` gives the pattern's matches in a text.
    """

    def __init__(self, find_all: Callable[[str], list[str]], model: Callable[[str], bytes], limit: int = CACHE_BYTES):
        self.find_all, self.model, self.known = find_all, model, Known(self._make, limit)

    def _make(self, piece: str) -> bytes:
        if piece[0] == _WHOLE:
            return self.model(piece[1:])
        if piece.isalpha():
            return self.model.after_blank(piece)
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():  # letters before one mark are two matches
            return self.known[piece[:-1]] + self.known[_WHOLE + piece[-1]]
        if piece[0] == _MARK:
            text = piece[1:]
            if text.isalpha():
                return self.model(text)
            if text[-1:] in (".", ",", ";", ":", "!", "?") and text[:-1].isalpha():
                return self.known[piece[:-1]] + self.known[_WHOLE + text[-1]]
        if not is_plain(piece):
            raise NeedsPattern
        return b"".join([self.known[_WHOLE + m] for m in self.find_all(piece_text(piece))])

    def __call__(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        cut = cut_level(text) if text else []
        if cut is not None:
            try:
                return b"".join(map(self.known.__getitem__, cut))
            except NeedsPattern:
                pass
        return b"".join([self.known[_WHOLE + m] for m in self.find_all(text)])


def picked(flat, starts, lengths):
    """The stretches of ``flat`` that begin at ``starts``, one after another."""
    import numpy as np

    ends = np.cumsum(lengths)
    places = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    places += np.arange(len(places), dtype=np.int32)
    return flat[places]


def latin_letters(data):
    """For each byte of UTF-8, whether it belongs to a letter of ASCII or of U+00C0 to U+017F."""
    import numpy as np

    lead = (data >= 0xC3) & (data <= 0xC5)
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1] & (data[1:] < 0xC0)
    sign = (data == 0x97) | (data == 0xB7)  # of U+00C0 to U+00FF only two are none
    after[1:] &= ~(sign[1:] & (data[:-1] == 0xC3))
    low = data | 0x20
    return (low >= 0x61) & (low <= 0x7A) | lead | after


class WordTable:
    """Ids of words in Arrow and numpy arrays; ``make`` gives the bytes of the ids of words that are not held.

    When ``limit`` bytes are taken, the half that has been held longest goes.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int):
        import numpy as np
        import pyarrow as pa

        self.make, self.limit = make, limit
        self.words, self.flat, self.lengths = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def places(self, wanted):
        """(starts, lengths) in ``flat`` of the ids of different words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.words.nbytes + self.flat.nbytes + self.lengths.nbytes > self.limit:
            half = len(self.words) // 2
            self.words, self.flat, self.lengths = self.words[half:], self.flat[int(self.lengths[:half].sum()) :], self.lengths[half:]
        found = pc.index_in(wanted, self.words).fill_null(-1).to_numpy()
        unseen = found < 0
        if unseen.any():
            fresh = wanted.filter(pa.array(unseen))
            made = self.make(fresh.to_numpy(zero_copy_only=False).tolist())
            found = np.where(unseen, len(self.words) - 1 + np.cumsum(unseen), found)
            self.words = pa.concat_arrays([self.words, fresh])
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(made), "<u4")))
            self.lengths = np.concatenate((self.lengths, np.fromiter(map(len, made), np.int32, len(made)) // 4))
        return (np.cumsum(self.lengths) - self.lengths)[found], self.lengths[found]


class ColumnIds:
    """Encodes Arrow columns of texts as a ``PieceIds`` does; Arrow cuts them and only distinct pieces are encoded.

    Pieces of Latin letters, alone or before ASCII marks, are parted in numpy, and their letters are held in a
    ``WordTable``; Python sees what is not held, and pieces of any other kind.  Texts that need the pattern or hold an
    added token's string go through ``encode`` one by one.
    """

    #: Bytes of a text above which it is encoded alone.
    LONG = 1 << 26
    #: Marks that the pattern leaves together after letters; an apostrophe may open a match with letters.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, by_piece: PieceIds, encode: Callable[[str], bytes], added: Iterable[str], limit: int = CACHE_BYTES):
        self.by_piece, self.encode, self.odd = by_piece, encode, [_MARK, _WHOLE, *added]
        self.table = WordTable(lambda words: by_piece.model.many([w[1:] if w[0] == _MARK else f" {w}" for w in words]), limit)

    def _piece(self, piece: str) -> bytes | None:
        """A cut piece's ids; None if its text needs the pattern."""
        if piece in ("", _MARK):
            return None
        try:
            return self.by_piece.known[piece]
        except NeedsPattern:
            return None

    def _looked_up(self, others: list[str], tails: list[str]) -> tuple[list[bytes | None], list[bytes]]:
        """(what ``_piece`` gives for the pieces that aren't parted, the ids of the marks behind letters)."""
        return [self._piece(p) for p in others], [self.by_piece.known[_WHOLE + t] if t else b"" for t in tails]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def _parted(self, pieces) -> tuple:
        """(which pieces are of Latin letters and marks, their letters, their marks), both as dictionaries."""
        import numpy as np
        import pyarrow as pa

        data, offsets = text_bytes(pa.array(pieces, pa.string()))
        starts, ends = offsets[:-1], offsets[1:]
        mark = np.zeros(256, bool)
        mark[list(self.MARKS.encode())] = True
        letters, marks = (np.concatenate(([0], np.cumsum(x, dtype=np.int32))) for x in (latin_letters(data), mark[data]))
        first = starts + ((starts < ends) & (np.append(data, 1)[starts] == 0))
        n = letters[ends] - letters[first]
        turn = first + n  # where the marks begin, if all letters come before them
        latin = (n > 0) & (letters[turn] - letters[first] == n) & (n + marks[ends] - marks[first] == ends - first)

        def cut(begins, stops):
            sizes = stops - begins
            buffers = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), picked(data, begins, sizes)
            return pa.Array.from_buffers(pa.string(), len(sizes), [None, *map(pa.py_buffer, buffers)]).dictionary_encode()

        return latin, cut(starts[latin], turn[latin]), cut(turn[latin], ends[latin])

    def _pieces(self, pieces) -> tuple:
        """(ids of all cut pieces, how many each has, places of those whose texts need the pattern)."""
        import numpy as np

        latin, heads, tails = self._parted(pieces)
        mine, rest = np.flatnonzero(latin), np.flatnonzero(~latin)
        starts, lengths = np.zeros((2, len(pieces), 2), np.int64)  # of a piece's letters, and of what follows or stands alone
        for held, found in zip((starts, lengths), self.table.places(heads.dictionary)):
            held[mine, 0] = found[heads.indices.to_numpy()]
        others, some = self._looked_up([pieces[i] for i in rest.tolist()], tails.dictionary.to_pylist())
        order = np.concatenate((tails.indices.to_numpy(), np.arange(len(some), len(some) + len(rest)))).astype(np.int64)
        some += [ids or b"" for ids in others]
        sizes, places = np.fromiter(map(len, some), np.int64, len(some)) // 4, np.concatenate((mine, rest))
        starts[places, 1], lengths[places, 1] = (len(self.table.flat) + np.cumsum(sizes) - sizes)[order], sizes[order]
        flat = np.concatenate((self.table.flat, np.frombuffer(b"".join(some), "<u4")))
        return picked(flat, starts.ravel(), lengths.ravel()), lengths.sum(axis=1), rest[[ids is None for ids in others]]

    def __call__(self, texts) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; ``texts`` holds no null."""
        import numpy as np
        import pyarrow.compute as pc

        alone = pc.greater(pc.binary_length(texts), self.LONG)
        for some in self.odd:
            alone = pc.or_(alone, pc.match_substring(texts, some))
        plain = pc.binary_join_element_wise(_MARK, pc.if_else(alone, "", texts), "")
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", f" \n {_MARK}"), " ")
        coded = cut.flatten().dictionary_encode()
        codes, rows = coded.indices.to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy())))
        flat, lengths, places = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False))
        none = np.zeros(len(lengths), bool)
        none[places] = True
        alone = np.logical_or.reduceat(none[codes], rows[:-1]) if len(rows) > 1 else []
        each = lengths[codes]
        found, bounds = picked(flat, (np.cumsum(lengths) - lengths)[codes], each), np.concatenate(([0], np.cumsum(each)))[rows].tolist()
        whole = iter(self._whole([texts[i].as_py() for i in np.flatnonzero(alone).tolist()]))
        return [next(whole) if a else found[bounds[i] : bounds[i + 1]].tobytes() for i, a in enumerate(alone)]


class BatchColumnIds(ColumnIds):
    """The same for an engine that encodes many words at once: what a column has that isn't held goes to it together.

    ``encode`` maps words to the bytes of their ids; ``find_all`` gives the pattern's matches in a text.
    """

    def __init__(self, find_all: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_BYTES):
        self.odd, self.others = [_MARK, _WHOLE], LevelEncoder(find_all, encode, limit // 2)
        self.table = WordTable(lambda words: encode([w[1:] if w[0] == _MARK else f" {w}" for w in words]), limit // 2)

    def _looked_up(self, others: list[str], tails: list[str]) -> tuple[list[bytes | None], list[bytes]]:
        none, cache = {"", _MARK}, self.others.cache
        cache.add(chain((p for p in others if p not in none), (_WHOLE + t for t in tails if t)))
        return [None if p in none else cache.known[p] for p in others], [cache.known[_WHOLE + t] if t else b"" for t in tails]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return self.others(texts)

    def __call__(self, texts) -> list[bytes]:
        import pyarrow as pa

        return super().__call__(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)


def level_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte, for ``str.translate`` of Latin-1 text."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class ModelIds:
    """Ids of single pre-tokenized words from the model of a tokenizers library tokenizer."""

    def __init__(self, library):
        self.tokenize, self.characters = library.model.tokenize, level_characters()
        self.packs, self.blank = [struct.Struct(f"<{n}I").pack for n in range(16)], self.characters[32]

    def many(self, words: list[str]) -> list[bytes]:
        """The ids of each word; none is empty or holds a line feed."""
        import numpy as np

        written = np.array([ord(self.characters.get(b, chr(b))) for b in range(256)], "<u2")
        joined = written[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        tokenize, packs, out = self.tokenize, self.packs, []
        for word in joined.split(self.characters[10]):
            ids = [t.id for t in tokenize(word)]
            out.append(packs[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids))
        return out

    def after_blank(self, letters: str) -> bytes:
        """The ids of a blank and letters."""
        if not letters.isascii():
            return self(f" {letters}")
        ids = [t.id for t in self.tokenize(self.blank + letters)]
        return self.packs[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)

    def letters(self, letters: str) -> bytes:
        """The ids of ASCII letters."""
        ids = [t.id for t in self.tokenize(letters)]
        return self.packs[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()  # only the blank is written otherwise
        found = self.tokenize(word.replace(" ", self.characters[32]) if plain else word.encode().decode("latin-1").translate(self.characters))
        ids = [t.id for t in found]
        return self.packs[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Encodes texts for a vocabulary that drops white space and never looks across it.

    The ids of a text are those of its chunks between ASCII white space; each distinct chunk is encoded once as long
    as the cache holds it.  Chunks of ASCII and precomposed Latin letters are lower-cased and cut here as the file's
    normalizer and pre-tokenizer do it, and the library's model encodes their words; all others go through the whole
    library.  ``library`` is a tokenizers.Tokenizer.
    """

    #: The pattern of the vocabulary file's pre-tokenizer.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SIMPLE = r"[!-~\u00c0-\u012f\u0131-\u017e]+"

    def __init__(self, library, limit: int = CACHE_BYTES):
        import regex

        self.library, self.model = library, ModelIds(library)
        self.simple, self.find_words = re.compile(self.SIMPLE).fullmatch, regex.compile(self.WORDS).findall
        self.added = [t.content for t in library.get_added_tokens_decoder().values()]
        #: Whether ASCII letters, alone or before one mark, hold no added token's string.
        self.letters_are_plain = not any(a[:-1].isalpha() or a.isalpha() or len(a) < 2 for a in self.added)
        self.chunks = Known(self.encode_chunk, limit)

    def encode_chunk(self, chunk: bytes) -> bytes:
        if self.letters_are_plain:
            if chunk.isalpha():  # ASCII letters
                return self.model.letters(chunk.decode()) if chunk.islower() else self.chunks[chunk.lower()]
            if chunk[-1] in b".,;:!?" and chunk[:-1].isalpha():  # they are two words
                return self.chunks[chunk[:-1].lower()] + self.chunks[chunk[-1:]]
        text = chunk.decode()
        if not self.simple(text) or any(a in text for a in self.added):
            return library_ids(self.library, text)
        low = text.lower()
        if low.isalpha():
            return self.model(low)
        return b"".join([self.chunks[w.encode()] if w.isalpha() else self.model(w) for w in self.find_words(low)])

    def __call__(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))


def library_ids(library, text: str) -> bytes:
    """What the tokenizers library gives for a text, as little-endian unsigned 32-bit integers."""
    ids = library.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)
