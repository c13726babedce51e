"""Token ids from the `tokenizers` library, with the ids of words already seen kept per worker."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides the space and the line end, and the null character, for a regular expression class (fixed values of Unicode).
_OTHER_SPACE = r"\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A word that ends in a letter and ASCII marks behind it.
_MARKED = re.compile(r"(.*[A-Za-zÀ-ɏ])([!-/:-@\[-`{-~]+)", re.S)


class WordTokenizer:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    The public BPE files split a text into pieces that never cross from a non-space to a space, so a text whose
    white space is single spaces and line ends may be encoded word by word. Each word with the space before it is
    encoded once, many words to a call, and looked up from then on. Any other text goes to the library whole, and so does
    one that holds the content of an added token (such as <|endoftext|>, which the library gives its one id), in any case.
    """

    def __init__(self, path: str, keep: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        added = "|".join("(?i:" + re.escape(t.content) + ")" for t in self._library.get_added_tokens_decoder().values())
        self._uneven = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[" + _OTHER_SPACE + "]" + ("|" + added if added else "")
        vocabulary = self._library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self._lower = any(k.endswith("</w>") for k in vocabulary)
        self._bytes = np.zeros(self.size, np.int64)
        for word, i in vocabulary.items():
            self._bytes[i] = len(word.removesuffix("</w>") if self._lower else word)
        self._keep = keep
        self._marks: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.large_string())
        self._start, self._length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self._ids, self._used = np.zeros(1 << 18, np.uint32), 0

    def _whole(self, text: str) -> list[int]:
        return self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _form(self, word: str) -> str:
        """The word as it is given to the library: after a space, or after a line end if it starts one or the text."""
        return word if word[0] == "\n" else "\n" + word[1:] if word[0] == "\x00" else " " + word

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Their ids one after the other, and how many each has."""
        ids_of, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            forms = [self._form(w) for w in part]
            ids = np.asarray(self._whole("".join(forms)), np.int64)
            lower = [f[1:].lower() for f in forms] if self._lower else forms
            wanted = np.cumsum([len(f) if f.isascii() else len(f.encode()) for f in lower])
            ends = np.cumsum(self._bytes[ids])
            cut = np.searchsorted(ends, wanted) + 1
            if len(ids) and ends[-1] == wanted[-1] and (ends[np.minimum(cut - 1, len(ends) - 1)] == wanted).all():
                n = np.diff(cut, prepend=0)
            else:  # a character that changes its length in lower case or normal form
                each = [self._whole(f) for f in forms]
                ids, n = np.asarray([i for e in each for i in e], np.int64), np.asarray([len(e) for e in each], np.int64)
            if not self._lower and (first := [k for k, w in enumerate(part) if w[0] == "\x00"]):
                # the line end that stands for the start of a text is a token of its own
                ids = np.delete(ids, (np.cumsum(n) - n)[first])
                n[first] -= 1
            ids_of.append(ids)
            counts.append(n)
        return np.concatenate(ids_of), np.concatenate(counts)

    def _add(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        k, used = len(self._known), self._used
        while used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while k + len(words) > len(self._start):
            self._start, self._length = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._length))
        self._ids[used : used + len(ids)] = ids
        self._start[k : k + len(words)], self._length[k : k + len(words)] = used + np.cumsum(n) - n, n
        self._used += len(ids)
        self._known = pa.concat_arrays([self._known, pa.array(words, pa.large_string())])

    def _ids_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self._length[at]
        ends = np.cumsum(n)
        return self._ids[np.repeat(self._start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of some different words is among the known ones; -1: nowhere. Only the shorter list is hashed."""
        place = lambda of, among: pc.index_in(of, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self._known) <= len(words):
            return place(words, self._known)
        found, out = place(self._known, words), np.full(len(words), -1, np.int64)
        there = np.flatnonzero(found >= 0)
        out[found[there]] = there
        return out

    def _learn(self, new: list[str]) -> np.ndarray:
        """Encode new words and keep their ids; their places."""
        # marks behind a letter are a piece of their own, so each stem is encoded once; a letter of two in lower case may end in a mark
        marked, stems, behind, whole = [], [], [], {}
        for k, w in enumerate(new):
            match = _MARKED.fullmatch(w) if not w[-1].isalnum() else None
            if match and len(match[1][-1].lower()) == 1:
                marked.append(k)
                stems.append(match[1])
                behind.append(match[2])
            else:
                whole[w] = len(self._known) + len(whole)
        places = np.empty(len(new), np.int64)
        different = list(dict.fromkeys(stems))
        place_of = dict(zip(different, self._places(pa.array(different, pa.large_string())).tolist(), strict=True))
        for stem, at in place_of.items():
            if at < 0:
                place_of[stem] = whole.setdefault(stem, len(self._known) + len(whole))
        self._add(list(whole), *self._encode_words(list(whole)))
        if marked:
            for mark in set(behind).difference(self._marks):
                self._marks[mark] = self._whole(mark)
            ids, n = self._ids_at(np.asarray([place_of[x] for x in stems]))
            tails = [self._marks[m] for m in behind]
            more = np.fromiter(map(len, tails), np.int64, len(tails))
            places[marked] = len(self._known) + np.arange(len(marked))
            self._add([new[k] for k in marked], np.insert(ids, np.repeat(np.cumsum(n), more), [i for t in tails for i in t]), n + more)
            if len(self._marks) > 100_000:
                self._marks = {}
        inner = np.ones(len(new), bool)
        inner[marked] = False
        places[inner] = [whole[new[k]] for k in np.flatnonzero(inner).tolist()]
        return places

    def _encode_even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts without other than single spaces and line ends, and without added tokens."""
        marked = pc.binary_join_element_wise(pa.scalar("\x00", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        split = pc.split_pattern(marked, " ")
        found = split.flatten().dictionary_encode()
        at = self._places(found.dictionary)
        if (new := np.flatnonzero(at < 0)).size:
            if len(self._known) + 2 * len(new) > self._keep:
                self._forget()
                new = np.arange(len(at))
            at[new] = self._learn(found.dictionary.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        ids, n = self._ids_at(at[found.indices.to_numpy()])
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return ids, np.diff(np.cumsum(n)[ends - 1], prepend=0) if len(ends) else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) one after the other, and how many each has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        uneven = pc.match_substring_regex(texts, self._uneven)
        odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        ids, lengths = self._encode_even(texts.filter(pc.invert(uneven)))
        if not len(odd):
            return ids, lengths
        others = [np.asarray(self._whole(texts[k].as_py()), np.uint32) for k in odd.tolist()]
        even = np.setdiff1d(np.arange(len(texts)), odd)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k, a, b in zip(even.tolist(), (np.cumsum(lengths) - lengths).tolist(), np.cumsum(lengths).tolist(), strict=True):
            parts[k] = ids[a:b]
        for k, own in zip(odd.tolist(), others, strict=True):
            parts[k] = own
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
