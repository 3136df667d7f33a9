"""Token ids of whole texts by a public tokenizer file.

The tokenizers library finds the ids. Where its file splits a lower-cased text into words, digits and marks and drops
white space (``SPLIT``), the ids of such a piece do not depend on its neighbours, so each worker keeps the words and
pieces that it has seen (about ``KEPT``) and passes only new ones to the library. Texts with other than common Latin characters,
or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT = 600_000
END_ID = 2
#: Fixed value: the split pattern for which pieces may be kept.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: All but printable ASCII and U+00A1 to U+017F without U+0130, which alone changes its length in lower case.
_ODD = "[^\t\n\r -~\u00a1-\u012f\u0131-\u017f]|<\\|"


def _of(category: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(33, 0x180) if unicodedata.category(chr(c))[0] == category)


_PIECE = re.compile(SPLIT.replace(r"\p{L}", _of("L")).replace(r"\p{N}", _of("N")))


class _Kept:
    """What was used lately: two generations of at most about ``most`` entries, of which the older one goes."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def lacks(self, keys) -> list[str]:
        """Those of ``keys`` that are new; the others are in ``now`` from here on."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        new = []
        for k in keys:
            if k not in self.now:
                if (old := self.before.get(k)) is None:
                    new.append(k)
                else:
                    self.now[k] = old
        return new


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.by_piece = _drops_white_space(path)
        self.words, self.pieces = _Kept(KEPT // 3), _Kept(KEPT // 2)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column without nulls, without special tokens. Best with some MB at once."""
        if not len(texts):
            return []
        if not self.by_piece:
            return self._whole(texts)
        odd = pc.match_substring_regex(texts, _ODD)
        if pc.any(odd).as_py():
            own, rest = iter(self._of_pieces(texts.filter(pc.invert(odd)))), iter(self._whole(texts.filter(odd)))
            return [next(rest) if x else next(own) for x in odd.to_pylist()]
        return self._of_pieces(texts)

    def _whole(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]

    def _of_pieces(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        self._learn(self.words.lacks(own))
        ids = list(map(self.words.now.__getitem__, own))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = pool[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [out[x:y] for x, y in zip(cuts, cuts[1:])]

    def _learn(self, new: list[str]) -> None:
        split = [_PIECE.findall(w) for w in new]
        unknown = self.pieces.lacks(dict.fromkeys(chain.from_iterable(split)))
        for at in range(0, len(unknown), 2000):
            some = unknown[at : at + 2000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(got.word_ids), minlength=len(some))).tolist()
            ids = np.asarray(got.ids, "<u4").tobytes()
            self.pieces.now.update((w, ids[4 * x : 4 * y]) for w, x, y in zip(some, [0, *ends], ends))
        get = self.pieces.now.__getitem__
        self.words.now.update((w, get(p[0]) if len(p) == 1 else b"".join(map(get, p))) for w, p in zip(new, split))


def _drops_white_space(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and split[0].get("type") == "Split" and split[0].get("invert") and split[0].get("behavior") == "Removed"
        and (split[0].get("pattern") or {}).get("Regex") == SPLIT
        and all(x.get("type") == "ByteLevel" and not x.get("use_regex", True) and not x.get("add_prefix_space") for x in split[1:])
        and not spec["model"].get("dropout")
    )


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
