"""Token ids of whole texts, computed once for each distinct piece of text."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What keeps a text from being cut the quick way: white space besides single blanks and line
#: feeds between words.
_NOT_QUICK = r"\n\n|  | \n| $|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters in any version of Unicode: Latin, Greek and Cyrillic ones.
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{481}\x{48a}-\x{513}"
_UNSURE = rf"[^\x00-\x7f{_LETTERS}]"
#: A piece that is one unit of the byte-level pattern, after a blank.
_UNIT = rf"\A (?:[{_LETTERS}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)\z"


def _kinds(beyond_ascii: int) -> bytes:
    """By byte: 1 letter, 2 digit, 4 other sign, 7 what may belong with any of them, 0 blank or line feed."""
    kinds = [4] * 128 + [beyond_ascii] * 128
    for k, signs in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (2, "0123456789"), (7, "'"), (0, " \n")):
        for x in signs:
            kinds[ord(x)] = k
    return bytes(kinds)


_SURE, _ANY = _kinds(1), _kinds(7)

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def _byte_signs() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary; a line feed stays, as it parts pieces."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, dtype="<u4")
    out[shown] = shown
    hidden = [b for b in range(256) if b not in set(shown)]
    out[hidden] = np.arange(256, 256 + len(hidden))
    out[10] = 10
    return out


class PieceTokenizer:
    """A byte-level BPE of the tokenizers library behind a bounded memo of pieces.

    Texts are cut before blanks, around line feeds, and between letters, digits and other signs: all
    borders of the byte-level pattern, so that ids of the pieces, put together, are those of the
    whole text. Apostrophes, and characters beyond ASCII in texts that have others than letters, are not
    cut off, as the pattern may take them with either side. Pieces are slices of the batch's own
    buffer, and Arrow looks them up; only new ones are encoded. Texts that cannot be cut so, that
    hold one of the vocabulary's added tokens, or whose tokenizer has another pattern, are encoded whole.
    What the memo holds never changes ids.
    """

    def __init__(self, path: str, max_entries: int = 300_000, longest: int = 40) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
        self._plain = self._is_plain()
        if self._plain:
            self._units = Tokenizer(self._tokenizer.model)  # the same model, for pieces that need no pattern
            self._units.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._signs = _byte_signs()
        strings = self._tokenizer.get_vocab()
        self._starts_blank = np.zeros(max(strings.values()) + 1, dtype=bool)
        self._starts_blank[[i for x, i in strings.items() if x[:1] == chr(self._signs[32])]] = True
        self._max, self._longest = max_entries, longest
        self._pieces = pa.array([], pa.binary())
        self._ids, self._lengths, self._uses = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _is_plain(self) -> bool:
        before, model = self._tokenizer.pre_tokenizer, self._tokenizer.model
        said = json.loads(before.__getstate__()) if before else {}
        return (
            said.get("type") == "ByteLevel"
            and said.get("use_regex", True)
            and not said.get("add_prefix_space")
            and self._tokenizer.normalizer is None
            and type(model).__name__ == "BPE"
            and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        )

    def whole(self, text: str) -> bytes:
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return array("I", found.ids).tobytes()

    def _encode_units(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces that are one unit after a blank each, and how many each has: one starts at each
        id whose string starts with a blank."""
        text = self._signs[np.frombuffer(b"\n".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self._units.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        starts = np.flatnonzero(self._starts_blank[ids])
        return (ids, np.diff(starts, append=len(ids))) if len(starts) == len(pieces) else None

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which pieces were encoded; their ids in that order, and how many each has."""
        unit = pc.match_substring_regex(pieces.view(pa.string()), _UNIT).to_numpy(zero_copy_only=False)
        ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]

        def each(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [x.ids for x in self._tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype="<u4"), np.array([len(x) for x in found], dtype=np.int64)

        order = [np.flatnonzero(unit), np.flatnonzero(~unit)]
        for rows, encode in zip(order, (self._encode_units, each), strict=True):
            mine = pieces.take(pa.array(rows)).to_pylist()
            for at in range(0, len(mine), 2000):
                part = mine[at : at + 2000]
                for out, x in zip((ids, lengths), encode(part) or each(part), strict=True):
                    out.append(x)
        return np.concatenate(order), np.concatenate(ids), np.concatenate(lengths)

    def _quick(self, texts: pa.Array, kinds: bytes) -> list[bytes]:
        """Ids of texts, none of them empty, which are cut where neighbours have no kind in common."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets, raw = offsets - offsets[0], data.to_pybytes()
        after = np.frombuffer(raw.translate(kinds), np.uint8)
        before = np.frombuffer(raw.translate(kinds[:32] + b"\x07" + kinds[33:]), np.uint8)  # a blank goes with what follows
        border = np.empty(len(raw), dtype=bool)
        np.equal(before[:-1] & after[1:], 0, out=border[1:])
        border[offsets[:-1]] = True
        starts = np.append(np.flatnonzero(border), len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), data])

        known = len(self._pieces)
        at = pc.fill_null(pc.index_in(pieces, value_set=self._pieces), -1).to_numpy().copy()
        missed = np.flatnonzero(at < 0)
        if len(missed):
            numbered = pieces.take(pa.array(missed)).dictionary_encode()
            order, ids, lengths = self._encode_pieces(numbered.dictionary)
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(known, known + len(order), dtype=np.int32)
            at[missed] = place[numbered.indices.to_numpy()]
            self._pieces = pa.concat_arrays([self._pieces, numbered.dictionary.take(pa.array(order))])
            self._ids, self._lengths = np.concatenate([self._ids, ids]), np.concatenate([self._lengths, lengths])
        self._uses = np.bincount(at, minlength=len(self._pieces)) + np.append(self._uses, np.zeros(len(self._pieces) - known, np.int64))
        first = np.cumsum(self._lengths) - self._lengths
        each = self._lengths[at]
        ends = np.cumsum(each)
        flat = self._ids[np.repeat(first[at] - (ends - each), each) + np.arange(ends[-1])]
        if len(missed):
            self._keep()
        ends = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _keep(self) -> None:
        """Let long new pieces go; of a full memo, the half that is used least, too."""
        keep = pc.binary_length(self._pieces).to_numpy() <= self._longest
        if len(keep) > self._max:
            keep[np.argpartition(self._uses, len(keep) - self._max // 2)[: len(keep) - self._max // 2]] = False
            self._uses //= 2  # what was frequent once goes in time
        if keep.all():
            return
        self._pieces = self._pieces.filter(pa.array(keep))
        self._ids = self._ids[np.repeat(keep, self._lengths)]
        self._lengths, self._uses = self._lengths[keep], self._uses[keep]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null gives none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "").cast(pa.string())
        quick = pc.and_(pc.invert(pc.match_substring_regex(texts, _NOT_QUICK)), pc.and_(pc.greater(pc.binary_length(texts), 0), pc.less(pc.binary_length(texts), 1 << 24)))
        for added in self._added:
            quick = pc.and_(quick, pc.invert(pc.match_substring(texts, added)))
        quick = quick.to_numpy(zero_copy_only=False) & self._plain
        unsure = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for mine, kinds in ((quick & ~unsure, _SURE), (quick & unsure, _ANY)):
            rows = np.flatnonzero(mine).tolist()
            if rows:
                for i, ids in zip(rows, self._quick(texts if len(rows) == len(texts) else texts.filter(pa.array(mine)), kinds), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(~quick).tolist():
            if text := texts[i].as_py():
                out[i] = self.whole(text)
        return out


_OPEN: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One per Python worker, so that its memo outlives a task."""
    if path not in _OPEN:
        _OPEN[path] = PieceTokenizer(path)
    return _OPEN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)
