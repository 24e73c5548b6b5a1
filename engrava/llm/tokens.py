"""Token ids of whole texts, a distinct word at a time.

Both tokenizers cut text where white space begins before any merge is made, so a text's ids are those of its words one after another.
Arrow splits a batch of texts into words and numbers the distinct ones; the library is asked for the ids of each word that a worker hasn't met
yet, and the texts' ids are gathered from a table of bounded size. Texts that hold the name of a special token go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps, and bytes of text split at once.
KEPT_WORDS, BYTES = 450_000, 4 << 20
#: Words that the library is asked for at once: what it returns takes some hundred bytes a token.
_ASKED = 1 << 14
#: Where splitting at single spaces and line ends isn't what the byte-level pattern does: a space before a line end, runs of three, of two at the end, and all
#: other Unicode white space (and the mark that is split at).
_UNEVEN = "[ \n]{3}|[ \n]{2}$| \n|[\x1f\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: A comma or full stop between a letter and white space is a word of its own, in either pattern.
_STOP = f"([{_LATIN}])([,.])([ \n])"
#: In texts of nothing but Latin letters, printable ASCII without apostrophes, and white space, so are letters, digits and all other marks where white space is dropped.
_PARTS, _OTHER = f"([{_LATIN}]+|[0-9]|[!-/:-@\\[-`{{-~]+)", f"[^\\t-\\r -~{_LATIN}]|'"


class WordTokenizer:
    """Ids by ``tokenizers`` for the vocabulary file ``path``. With ``spaced`` a word takes the space before it along, else white space is dropped.

    The name of a special token in a text gives that token, as the library does by default.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.mark = "\n" if spaced else " \0 "
        self.special = "|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self, most: int = 0) -> None:
        """Keep at most ``most`` words: those that most batches held."""
        if not most:
            self.row: dict[str, int] = {}
            self.first, self.count, self.seen, self.pool, self.used = *(np.zeros(1 << 16, np.int32) for _ in range(3)), np.zeros(1 << 18, "<u4"), 0
            return
        n = len(self.row)
        least = 2 + int(np.searchsorted(-np.cumsum(np.bincount(self.seen[:n])[::-1])[::-1][2:], -most))
        kept = np.flatnonzero(self.seen[:n] >= least)
        words = list(self.row)
        self.row = {words[k]: r for r, k in enumerate(kept.tolist())}
        first, count = self.first[kept], self.count[kept]
        stops = np.cumsum(count)
        ids = self.pool[np.repeat(first - stops + count, count) + np.arange(int(stops[-1]) if len(stops) else 0)]
        self.pool[: len(ids)], self.used = ids, len(ids)
        self.first[: len(kept)], self.count[: len(kept)], self.seen[: len(kept)] = stops - count, count, 1
        self.seen[len(kept) :] = 0

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and the number of each word's."""
        # Joined by a mark that the patterns always set apart, words cost half as much; such as could join with it are done alone.
        core, joined = self.mark.strip(" "), self.mark.join(words)
        between = f"{self.mark}{joined}{self.mark}"
        blank = any(f"{self.mark}{w}{self.mark}" in between for w in ("", " ")) or between.count(core) != len(words) + 1
        if not blank and len(words) > 1:
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(words) - 1:
                return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        alone = [k for k, w in enumerate(words) if w.strip(" ") == "" or core in w] if blank else []
        if alone and len(alone) < len(words):
            lone = set(alone)
            rest = [k for k in range(len(words)) if k not in lone]
            parts: list = [None] * len(words)
            for which in (alone, rest):
                ids, sizes = self._each([words[k] for k in which]) if which is alone else self._ids([words[k] for k in which])
                for k, x in zip(which, np.split(ids, np.cumsum(sizes)[:-1])):
                    parts[k] = x
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return self._each(words)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Each word's row of the table; new ones are added."""
        if len(self.row) > KEPT_WORDS:
            self._forget(KEPT_WORDS // 2)
        rows = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        self.seen[rows[rows >= 0]] += 1
        if not len(missing):
            return rows
        new = [words[k] for k in missing.tolist()]
        parts = [self._ids(new[k : k + _ASKED]) for k in range(0, len(new), _ASKED)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        at, total = len(self.row), len(ids)
        while at + len(new) > len(self.first):
            self.first, self.count, self.seen = (np.append(x, np.zeros_like(x)) for x in (self.first, self.count, self.seen))
        while self.used + total > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + total] = ids
        self.count[at : at + len(new)] = sizes
        self.first[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.seen[at : at + len(new)] = 1
        rows[missing] = range(at, at + len(new))
        self.row.update(zip(new, range(at, at + len(new))))
        return rows

    def _split(self, texts: pa.Array) -> pa.ListArray:
        if not self.spaced:
            plain = not pc.any(pc.match_substring_regex(texts, _OTHER)).as_py()
            return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _PARTS, "\\1 ") if plain else pc.replace_substring_regex(texts, _STOP, "\\1 \\2\\3"))
        marked = pc.replace_substring_regex(texts, _STOP, "\\1\x1f\\2\\3")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(marked, " ", "\x1f "), "\n", "\x1f\n\x1f"), "\x1f")

    def batch(self, texts: pa.Array, at_once: int = BYTES) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers; of null and empty texts none. So many bytes are split at once: fewer take less memory and more time."""
        texts = pc.fill_null(texts, "")
        apart = np.asarray(pc.match_substring_regex(texts, _UNEVEN if self.spaced else _OTHER)).astype(np.int8)
        if self.special:
            apart[np.asarray(pc.match_substring_regex(texts, self.special))] = 2
        out: list = [None] * len(texts)
        size = pc.binary_length(texts).to_numpy()
        for kind, encode in enumerate((self._some, self._whole if self.spaced else self._some, self._whole)):
            mine = np.flatnonzero(apart == kind)
            groups = np.cumsum(size[mine]) // at_once
            for g in np.unique(groups):
                part = mine[groups == g]
                for k, raw in zip(part.tolist(), encode(texts.take(pa.array(part)))):
                    out[k] = raw
        return out

    def _whole(self, texts: pa.Array) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]

    def _some(self, texts: pa.Array) -> list[bytes]:
        split = self._split(texts)
        coded = split.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())
        first, count, codes = self.first[rows], self.count[rows], coded.indices.to_numpy()
        sizes = count[codes]
        stops = np.cumsum(sizes, dtype=np.int32 if len(sizes) < 1 << 24 else np.int64)  # a word that is kept has few ids
        index = np.repeat(first[codes] - stops + sizes, sizes)
        index += np.arange(len(index), dtype=index.dtype)
        raw = self.pool[index].tobytes()
        words = np.cumsum(pc.list_value_length(split).to_numpy())
        ends = np.where(words > 0, 4 * stops[words - 1].astype(np.int64), 0).tolist() if len(stops) else [0] * len(texts)
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def word_tokenizer(path: str, spaced: bool) -> WordTokenizer:
    """One tokenizer for each worker process."""
    return WordTokenizer(path, spaced)


def vocabulary(name: str) -> str:
    """Where the file of a public vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Vocabulary file, and whether a word takes the space before it along, by short name.
VOCABULARIES = {"word_bpe_49k": ("word_bpe_49k.json", False), "byte_bpe_50k": ("byte_bpe_50k.json", True)}
