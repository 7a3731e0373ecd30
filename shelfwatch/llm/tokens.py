"""Token ids of whole texts, from a public vocabulary file, with a memo of words."""

from __future__ import annotations

import re
from array import array
from itertools import pairwise

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Words kept in a worker's memo before it starts anew; bounds its memory, changes no result.
MEMO_WORDS = 700_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    return public_tokenizers.path(name)


#: An ASCII letter or digit before a mark other than the apostrophe: the pattern of
#: ``word_bpe_49k.json`` cuts there anyway, so a space changes no id and spares distinct words.
_CUT = re.compile(rb"([0-9a-z])([!-&(-/:-@])")
#: A word that is one piece of its own, put between words that are encoded together.
_BETWEEN = b"\x01"


#: Words of lower-case letters up to U+00FF alone: one piece of the pattern in normal form, so the model takes them as they are.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: The model's characters for bytes: themselves if they can be seen, others in turn from U+0100 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


class WordEncoder:
    """Ids of a vocabulary whose rules never join what ASCII white space parts.

    That holds for ``word_bpe_49k.json``: white space and case are dropped, pieces of its pattern hold
    no white space, and its normal form does not look across it. So a text's ids are those of its
    words in turn, and only words not met before go through the tokenizer, many at a time with
    ``_BETWEEN`` between them. Words of plain letters go to the tokenizer's model alone, which spares them its
    normal form and pattern; words that may hold a special token's text are encoded alone.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self._encode(_BETWEEN)
        if len(self.mark) != 1:
            raise ValueError("the vocabulary cuts the word used between words")
        #: Little-endian ids of each word met.
        self.memo: dict[bytes, bytes] = {}

    def _encode(self, text: bytes) -> np.ndarray:
        # The fast way keeps no offsets; the ids are the same.
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        letters, ids, ends = [w for w in words if _PLAIN(w)], array("I"), [0]
        for w in letters:
            ids.extend([token.id for token in self.model.tokenize(w.decode("latin-1").translate(_BYTES))])
            ends.append(4 * len(ids))
        whole = np.array(ids, "<u4").tobytes()
        self.memo.update(zip(letters, [whole[i:j] for i, j in pairwise(ends)], strict=True))
        words = [w for w in words if w not in self.memo]
        plain = [w for w in words if b"<|" not in w and _BETWEEN not in w]
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            ids = self._encode((b" " + _BETWEEN + b" ").join(part))
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(part) - 1:
                raise ValueError("the vocabulary does not keep words apart")
            whole, starts, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            self.memo.update((w, whole[i:j]) for w, i, j in zip(part, starts, ends, strict=True))
        for w in words:
            if b"<|" in w or _BETWEEN in w:
                self.memo[w] = self._encode(w).tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The little-endian 32-bit ids of each UTF-8 text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        split = [(t if b"<|" in t else _CUT.sub(rb"\1 \2", t.lower())).split() for t in texts]
        memo = self.memo
        found = [list(map(memo.get, words)) for words in split]
        missing = [[i for i, known in enumerate(ids) if known is None] if None in ids else () for ids in found]
        new = {words[i] for words, places in zip(split, missing, strict=True) for i in places}
        if new:
            self._learn(list(new))
            for words, ids, places in zip(split, found, missing, strict=True):
                for i in places:
                    ids[i] = memo[words[i]]
        return list(map(b"".join, found))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
