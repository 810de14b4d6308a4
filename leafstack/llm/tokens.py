"""Encoding with a byte-level BPE of the tokenizers library, fast on texts whose words come again.

A text is cut before each space that a non-space character follows. No pre-token of the byte-level
pattern reaches over such a place, so the chunks' ids joined are the text's ids. The chunks of many texts
are numbered by Arrow, each distinct one is encoded once, and numpy lays their ids out in the order of the
texts. Chunks of ASCII and Latin letters are cut into pre-tokens here; a worker keeps the ids of those it
has met, and the new ones go to the library's BPE model in one call. Any other chunk, texts with runs of
white space and texts with an added token's string in them take the library's whole encoder.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafstack.llm.bpe import PATTERN, byte_letters
from leafstack.llm.common import worker_keeps

#: A worker keeps about so many pre-tokens.
PIECES_KEPT = 900_000
#: Code points of text that are encoded together, and chunks that are laid out together.
GROUP_CHARS, LAID_CHUNKS = 4_000_000, 500_000
#: Letters of ASCII, Latin-1 and Latin Extended A and B; with printable ASCII, tab and line ends no class of the pattern is in doubt.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SIMPLE = re.compile(f"[\\t\\n\\r\x20-\x7e{_LETTERS}]*")
_PIECES = re.compile(PATTERN.replace(r"\p{L}+", f"[{_LETTERS}]+").replace(r"\p{N}+", "[0-9]+").replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}0-9]"))


class ChunkIds:
    """Encodes texts; keeps the ids, as bytes, of pre-tokens it has met."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.dtype, self.met = np.dtype(dtype), {}
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # takes pre-tokens in byte-level letters, of which none is white space, with spaces between them
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = np.array([ord(letters[b]) for b in range(256)], dtype="<u4")
        self.letters[0] = ord(" ")      # pre-tokens cut here hold no control characters but tab and line ends
        self.spaced = np.zeros(vocab_size(path), dtype=bool)
        self.spaced[[i for token, i in self.whole.get_vocab().items() if token.startswith(letters[0x20])]] = True

    def _array(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=self.dtype)

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _model_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens, in one call.

        A token that begins with a space is the first of a pre-token that does; before each other one goes a space of its own.
        """
        bare = np.array([p[0] != " " for p in pieces])
        raw = "\0".join([" \0" + p if b else p for p, b in zip(pieces, bare.tolist(), strict=True)]).encode()
        text = self.letters[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        at, made, width = np.flatnonzero(self.spaced[ids]), ids.tobytes(), self.dtype.itemsize
        return [made[b:e] for b, e in zip(((at + bare) * width).tolist(), (np.append(at[1:], len(ids)) * width).tolist(), strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        """Have the ids of all these pre-tokens."""
        new = list(set(pieces).difference(self.met))
        if not new:
            return
        if len(self.met) + len(new) > PIECES_KEPT:
            self.met.clear()
            new = list(set(pieces))
        self.met.update(zip(new, self._model_ids(new), strict=True))

    def _simple(self, text: str) -> bytes:
        """The ids of a text of simple characters, by its pre-tokens."""
        pieces = _PIECES.findall(text)
        self._learn(pieces)
        return b"".join(map(self.met.__getitem__, pieces))

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of ' ' + chunk for all chunks, where those of each start, and how many they are; none for chunks that start with white space or are empty."""
        simple, other = [], []
        inside = [k for k, c in enumerate(chunks) if c[:1].strip()]
        text = " " + " ".join([chunks[k] for k in inside])
        if _SIMPLE.fullmatch(text):
            simple = inside
        else:
            for k in inside:
                (simple if _SIMPLE.fullmatch(chunks[k]) else other).append(k)
            text = " " + " ".join([chunks[k] for k in simple])
        ids = self._array(self._simple(text)) if simple else np.zeros(0, self.dtype)
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[simple] = at = np.flatnonzero(self.spaced[ids])      # no other token of a chunk begins with a space
        sizes[simple] = np.diff(at, append=len(ids))
        made = [self.encode(" " + chunks[k]) for k in other]
        sizes[other] = [len(m) // self.dtype.itemsize for m in made]
        starts[other] = len(ids) + np.cumsum(sizes[other]) - sizes[other]
        return np.concatenate((ids, self._array(b"".join(made)))), starts, sizes

    def _firsts(self, chunks: list[str]) -> list[bytes]:
        """The ids of the starts of texts, which have no space before them."""
        cut = [_PIECES.findall(c) if _SIMPLE.fullmatch(c) else None for c in chunks]
        self._learn([p for pieces in cut if pieces for p in pieces])
        return [self.encode(c) if pieces is None else b"".join(map(self.met.__getitem__, pieces)) for c, pieces in zip(chunks, cut, strict=True)]

    def _group(self, texts: list[str]) -> list[bytes]:
        whole = [any(a in t for a in self.added) for t in texts]
        lists = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        ends = lists.offsets.to_numpy()
        numbered = lists.flatten().dictionary_encode()
        which = numbered.indices.to_numpy()
        ids, starts, sizes = self._chunks(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        laid = self._laid(ids, starts, sizes, which)
        at = np.concatenate(([0], np.cumsum(sizes[which])))[ends] * self.dtype.itemsize
        odd = np.concatenate(([0], np.cumsum(sizes[which] == 0)))
        firsts = self._firsts(pc.list_element(lists, 0).to_pylist())
        out = []
        for k, text in enumerate(texts):
            b, e = ends[k], ends[k + 1]
            if whole[k] or odd[e] > odd[b + 1]:
                out.append(self.encode(text))
            else:       # the first chunk was laid out as if a space were before it
                out.append(firsts[k] + laid[at[k] + sizes[which[b]] * self.dtype.itemsize:at[k + 1]])
        return out

    def _laid(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> bytes:
        """The ids of the chunks `which`, one after the other."""
        out = []
        for at in range(0, len(which), LAID_CHUNKS):
            some = which[at:at + LAID_CHUNKS]
            n = sizes[some]
            ends = np.cumsum(n)
            out.append(ids[np.repeat(starts[some] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        held, chars = [], 0
        for t in texts:
            if held and chars + len(t) > GROUP_CHARS:
                yield from self._group(held)
                held, chars = [], 0
            held.append(t)
            chars += len(t)
        if held:
            yield from self._group(held)

    def ids(self, text: str) -> bytes:
        return next(self.batch([text]))


def chunk_ids(path: str, dtype: str) -> ChunkIds:
    return worker_keeps(("chunk ids", path, dtype), lambda: ChunkIds(path, dtype))


@functools.lru_cache(maxsize=4)
def vocab_size(path: str) -> int:
    """One more than the largest id."""
    from tokenizers import Tokenizer
    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
