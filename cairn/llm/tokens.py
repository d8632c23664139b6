"""Token ids of whole texts by a public word-level BPE vocabulary.

Texts are split at ASCII white space, which no token of this vocabulary crosses.
The distinct words of a batch are tokenized once and their ids are dealt out to
every place by array operations. A word of Latin letters, digits and signs goes
to a fast encoder with the same merges; any other word, such as one with an
apostrophe, goes to the tokenizer of the vocabulary file itself.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
#: Ends a pre-token, and a word, in what the fast encoder reads.
STOP, WORD = "\x01", "\x02"
#: Characters up to here are lower-cased and composed alike by every library; İ is the exception.
PLAIN = 0x24F


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of white-space words."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters, ranks, stop = _byte_letters(), {}, STOP.encode()
        for token, i in vocabulary.items():
            ends = token.endswith(END)
            body = token[: -len(END)] if ends else token
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + stop * ends] = i
        # the stop and word marks are taken from bytes that no plain word holds
        ranks = {k: v for k, v in ranks.items() if not (len(k) == 1 and k in (stop, WORD.encode()))}
        self.mark = max(vocabulary.values()) + 1
        ranks |= {WORD.encode(): self.mark, stop: self.mark + 1}
        self.fast = tiktoken.Encoding("words", pat_str=rf"[^{STOP}{WORD}]+{STOP}|{WORD}", mergeable_ranks=ranks, special_tokens={})
        self.plain = regex.compile(rf"[\x20-\x26\x28-\x7e\xa1-\xac\xae-įı-{chr(PLAIN)}]*")
        known = [chr(c) for c in range(PLAIN + 1)]
        #: 0 space, 1 letter, 2 digit (each alone), 3 other
        self.kind = np.array([0 if c == " " else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in known], np.int8)

    def _encode_plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Words separated by one space, without apostrophes or characters beyond PLAIN."""
        codes = np.frombuffer(unicodedata.normalize("NFC", joined).lower().encode("utf-32-le"), np.uint32)
        kind = self.kind[codes]
        ends = kind != 0
        ends[:-1] &= (kind[:-1] != kind[1:]) | (kind[:-1] == 2)
        marked = np.where(kind == 0, np.uint32(ord(WORD)), codes)
        at = np.arange(len(codes)) + np.cumsum(ends) - ends
        out = np.full(len(codes) + int(ends.sum()) + 1, ord(STOP), np.uint32)
        out[at] = marked
        out[-1] = ord(WORD)
        ids = self.fast.encode_to_numpy(out.tobytes().decode("utf-32-le"), disallowed_special=())
        marks = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of non-empty words one after another, and how many each has."""
        joined = " ".join(words.to_pylist())
        if self.plain.fullmatch(joined):
            return self._encode_plain(joined)
        listed = words.to_pylist()
        plain = [i for i, w in enumerate(listed) if self.plain.fullmatch(w)]
        other = sorted(set(range(len(listed))) - set(plain))
        counts = np.zeros(len(listed), np.int64)
        fast, counts[plain] = self._encode_plain(" ".join([listed[i] for i in plain])) if plain else (np.zeros(0, np.uint32), [])
        slow = [e.ids for e in self.whole.encode_batch_fast([listed[i] for i in other], add_special_tokens=False)]
        counts[other] = [len(x) for x in slow]
        of_other = np.zeros(len(listed), bool)
        of_other[other] = True
        out = np.zeros(int(counts.sum()), np.uint32)
        place = np.repeat(of_other, counts)
        out[~place] = fast
        out[place] = [i for x in slow for i in x]
        return out, counts

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (null: none) one after another, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        words = pc.ascii_split_whitespace(texts)
        per_text, flat = np.diff(words.offsets.to_numpy()), words.flatten()
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = flat.dictionary_encode()
        listed = coded.dictionary
        empty = pc.index(listed, pa.scalar("", listed.type)).as_py()  # white space at either end of a text
        if empty >= 0:
            ids, counts = self.encode_words(pa.concat_arrays([listed[:empty], listed[empty + 1 :]])) if len(listed) > 1 else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            counts = np.insert(counts, empty, 0)
        else:
            ids, counts = self.encode_words(listed)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pa.array(ids))
        codes = coded.indices
        out = lists.take(codes).flatten().to_numpy()
        edge = np.concatenate([[0], np.cumsum(counts[codes.to_numpy(zero_copy_only=False)])])
        ends = np.cumsum(per_text)
        return out, edge[ends] - edge[ends - per_text]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One a process and file."""
    return WordTokenizer(path)
