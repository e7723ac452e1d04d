"""Exact batch tokenisation with public byte-level BPE files.

Pre-tokens never cross a lone space or a lone newline between other characters, so
texts are cut there, equal pieces are found once per batch by Arrow's dictionary
encoding, and only pieces that a worker has not met before are merged. Texts with
adjacent or unusual white space go to the library whole.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sluice.llm.wordbytes import ragged_take, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes whose presence sends a text to the library whole: white space other than
#: space and newline, or characters that some libraries count as such.
_ODD = np.zeros(256, dtype=bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[10, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?|")] = True
_NEWLINE_ID = 198
CACHE_ENTRIES = 250_000


class ByteBpe:
    """ids of texts as ``tokenizers`` gives them for a byte-level BPE file."""

    def __init__(self, json_path: str, ranks_path: str | None):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import public_tokenizers

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.used = 0
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _add(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), dtype=np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.known.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces))))
        self.starts = np.concatenate([self.starts, starts + self.used])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(ids)

    def _learn(self, missing: list[str]) -> None:
        """Encode pieces not met before. Latin pieces are merged in one call with
        newlines between (a newline's id then parts them); the rest go to the
        library one by one."""
        easy, rest = [], missing
        if self.fast:
            easy = [p for p in missing if p and (p.isascii() or max(p) < "\u0250") and p[-1] not in "\n "]
            got = set(easy)
            rest = [p for p in missing if p not in got]
        if easy:
            ids = np.asarray(self.fast.encode_ordinary("\n".join(easy)), dtype=np.uint32)
            stops = np.append(np.flatnonzero(ids == _NEWLINE_ID), len(ids))
            starts = np.concatenate([[0], stops[:-1] + 1])
            self._add(easy, ids, starts, stops - starts)
        for piece in rest:
            ids = self.whole(piece)
            self._add([piece], ids, np.zeros(1, dtype=np.int64), np.array([len(ids)]))

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a piece starts at each byte, whether each text is plain)."""
        cut = np.zeros(len(raw) + 1, dtype=bool)
        space = _SPACE[raw]
        cut[:-1] = space  # before a space or newline
        cut[1:] |= raw == 10  # after a newline
        cut[1:-1] |= _LETTER[raw[:-1]] & _STOP[raw[1:]]
        odd = _ODD[raw]
        wide = (raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3))
        at = np.flatnonzero(wide)
        if len(at):
            one, two = raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
            lead = raw[at]
            blank = (lead == 0xC2) & ((one == 0x85) | (one == 0xA0))
            blank |= (lead == 0xE1) & (one == 0x9A) & (two == 0x80)
            blank |= (lead == 0xE2) & (((one == 0x80) & ((two <= 0x8B) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F)))
            blank |= (lead == 0xE3) & (one == 0x80) & (two == 0x80)
            odd[at[blank]] = True
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[offsets] = True
        odd[1:] |= space[:-1] & space[1:] & ~first[1:-1]
        cut |= first
        flagged = np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1
        plain = np.ones(len(offsets) - 1, dtype=bool)
        plain[flagged] = False
        return cut, plain

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        raw, offsets = text_bytes(texts)
        if not len(raw):
            return [np.zeros(0, dtype=np.uint32)] * len(texts)
        cut, plain = self._cuts(raw, offsets)
        for token in self.special:
            plain &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(cut)
        part = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])
        bounds = np.searchsorted(at, offsets)
        if not plain.all():
            inside = np.repeat(plain, np.diff(bounds))
            part = part.filter(pa.array(inside))
            bounds = np.concatenate([[0], np.cumsum(np.where(plain, np.diff(bounds), 0))])
        coded = part.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_ENTRIES:
            self._clear()
        missing = [p for p in distinct if p not in self.known]
        if missing:
            self._learn(missing)
        number = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        flat, placed = ragged_take(self.flat, self.starts, self.sizes, number[index])
        ends = placed[bounds]
        return [flat[ends[d] : ends[d + 1]] if plain[d] else self.whole(texts[d].as_py()) for d in range(len(texts))]
