"""Fast exact encoding with the tokenizers library: distinct pieces of text are encoded once and looked up.

A text is cut into pieces where the tokenizer's own pre-tokenisation always cuts (before a lone space or line break,
or at white space for tokenizers that drop it), so the ids of a text are those of its pieces in turn. Texts for which
that can't be told (runs of white space, spelled-out special tokens) are encoded whole.
"""

from __future__ import annotations

import functools
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that one worker keeps; the store starts anew beyond that.
MAX_PIECES = 800_000
#: Two adjacent characters that any of the tokenizers may take for white space.
SPACE_RUN = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]{2}"
MARK = "\x01"
#: A letter or digit, then closing punctuation: tokenizers' patterns never join the two.
CLOSING = r"(?s)^(?P<stem>.*[\p{L}\p{N}])(?P<tail>[.,;:!?]+)$"
#: Lower-case letters that normalisation leaves alone.
SIMPLE = r"^[a-zß-öø-ÿ]+$"
SENTENCE_END = r"""[.!?]["')\]]*$"""


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass
class Pieces:
    """Texts as pieces: ``codes`` of all pieces in turn, each text's end in them; a code's ids are
    ``pool[first[code] : first[code] + count[code]]``; ``stops`` marks codes that end a sentence."""

    codes: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    count: np.ndarray
    pool: np.ndarray
    stops: np.ndarray

    def ids(self) -> np.ndarray:
        n = self.count[self.codes]
        after = np.cumsum(n)
        shift = np.repeat(self.first[self.codes] - after + n, n)
        return self.pool[shift + np.arange(len(shift))]

    def text_ends(self) -> np.ndarray:
        """Each text's end in ``ids()``."""
        return np.concatenate([[0], np.cumsum(self.count[self.codes])])[self.ends]


class PieceEncoder:
    """Encodes texts piece by piece. ``spaced``: white space is part of the ids (byte-level BPE).

    A piece is looked up as a stem and closing punctuation, between which every such tokenizer cuts.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.spaced = self._ids(" a ") != self._ids("a")
        self._forget()
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.edges = np.zeros(max(words.values()) + 1, bool)
        self.mark = self._ids(MARK)
        if self.spaced:  # ids that start a key
            self.edges[[i for w, i in words.items() if w[0] in "ĠĊ"]] = True
        else:  # ids that end a word
            self.edges[[i for w, i in words.items() if w.endswith("</w>")]] = True
            self.simple = self._simple(path)

    def _simple(self, path: str):
        """The same model for keys that normalisation leaves alone and that are one pre-token each."""
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        t.normalizer = None
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return t

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.first, self.count, self.stops = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool = np.zeros(0, np.int32)

    def _each(self, keys: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)]

    def _apart(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self._each(keys)
        return np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(p) for p in each], np.int64)

    def _together(self, keys: list[str], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of keys, end to end, and their numbers; ids that only start or end a key, or a mark between two, tell them apart."""
        if simple or self.spaced:
            by, between = (self.simple, " ") if simple else (self.tokenizer, "")
            ids = np.array(by.encode_batch_fast([between.join(keys)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.edges[ids])
            if len(cuts) == len(keys) and (simple or cuts[0] == 0):
                return ids, np.diff(cuts, prepend=-1) if simple else np.diff(cuts, append=len(ids))
        else:
            ids = np.array(self._ids(f" {MARK} ".join(keys)), np.int32)
            marks = ids == self.mark[0]
            cuts = np.flatnonzero(marks)
            if len(cuts) == len(keys) - 1:
                return ids[~marks], np.diff(cuts, prepend=-1, append=len(ids)) - 1
        return self._apart(keys)

    def _add(self, keys: pa.Array) -> np.ndarray:
        """Encodes distinct keys that are not known; returns their places."""
        special = pc.or_(pc.match_substring(keys, "<|"), pc.match_substring(keys, MARK)).to_numpy(zero_copy_only=False)
        easy = pc.match_substring_regex(keys, r"^[ \n]." if self.spaced else SIMPLE).to_numpy(zero_copy_only=False) & ~special
        marked = np.zeros(len(keys), bool) if self.spaced or len(self.mark) != 1 else ~easy & ~special
        groups = [np.flatnonzero(g) for g in (easy, marked, ~easy & ~marked)]
        easy, marked, others = (keys.take(pa.array(g)).to_pylist() for g in groups)
        found = [self._together(easy[i : i + 512], not self.spaced) for i in range(0, len(easy), 512)]
        found += [self._together(marked[i : i + 512], False) for i in range(0, len(marked), 512)]
        found.append(self._apart(others))
        added = pa.array(easy + marked + others, pa.string())
        n = np.concatenate([n for _, n in found])
        places = np.empty(len(keys), np.int64)
        places[np.concatenate(groups)] = len(self.known) + np.arange(len(keys))
        self.known = pa.concat_arrays([self.known, added])
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in found)])
        stops = pc.match_substring_regex(added, SENTENCE_END).to_numpy(zero_copy_only=False)
        self.stops = np.concatenate([self.stops, stops]).astype(bool)
        return places

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Places of distinct keys among the known ones, where they are put if need be."""
        if len(self.known) + len(keys) > MAX_PIECES:
            self._forget()
        found = pc.index_in(keys, value_set=self.known)
        places = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            places[places < 0] = self._add(keys.filter(pc.is_null(found)))
        return places

    def _lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first, count, pool, stops of distinct words."""
        parts = pc.extract_regex(words, pattern=CLOSING)
        stems = pc.coalesce(pc.struct_field(parts, "stem"), words).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(parts, "tail"), "").dictionary_encode()
        keys = pa.concat_arrays([stems.dictionary, tails.dictionary]).dictionary_encode()  # a tail may be a stem, too
        places = self._places(keys.dictionary)[keys.indices.to_numpy()]
        stem = places[: len(stems.dictionary)][stems.indices.to_numpy()]
        tail = places[len(stems.dictionary) :][tails.indices.to_numpy()]
        both = np.stack([stem, tail], 1).ravel()
        n = self.count[both]
        after = np.cumsum(n)
        pool = self.pool[np.repeat(self.first[both] - after + n, n) + np.arange(after[-1] if len(n) else 0)]
        count = n[0::2] + n[1::2]
        stops = np.where(n[1::2] > 0, self.stops[tail], self.stops[stem])
        return np.cumsum(count) - count, count, pool, stops

    def pieces(self, text: pa.Array) -> Pieces:
        """The pieces of texts (no nulls)."""
        odd = pc.match_substring(text, "<|")
        if self.spaced:
            odd = pc.or_(odd, pc.match_substring_regex(text, SPACE_RUN))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.if_else(pa.array(odd), "", text) if odd.any() else text
        if self.spaced:
            lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        else:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if self.spaced:  # a text's first piece has no space before it
            begins = offsets[:-1][np.diff(offsets) > 0]
            starts, places = np.unique(codes[begins], return_inverse=True)
            codes[begins] = len(words) + places
            spaced = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(pa.scalar(" "), words, ""))
            words = pa.concat_arrays([spaced, words.take(pa.array(starts))])
        first, count, pool, stops = self._lookup(words)
        if odd.any():
            which = np.flatnonzero(odd)
            whole = self._each([text[int(i)].as_py() for i in which])
            n = np.array([len(p) for p in whole], np.int64)
            known = len(count)
            first, count = np.concatenate([first, len(pool) + np.cumsum(n) - n]), np.concatenate([count, n])
            stops = np.concatenate([stops, np.ones(len(n), bool)])
            pool = np.concatenate([pool, *whole])
            # an odd text stands as one piece, in place of those of the empty text
            parts, sizes, at = [], np.diff(offsets), 0
            for k, i in enumerate(which):
                parts += [codes[at : offsets[i]], [known + k]]
                at, sizes[i] = offsets[i + 1], 1
            codes = np.concatenate([*parts, codes[at:]]).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        return Pieces(codes, offsets[1:], first, count, pool, stops)


@functools.lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker and vocabulary."""
    return PieceEncoder(path)


def with_end(pieces: Pieces, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with ``end_id`` after each text, and each text's end in them."""
    ends = pieces.text_ends()
    return np.insert(pieces.ids(), ends, end_id).astype("<u4"), ends + 1 + np.arange(len(ends))
