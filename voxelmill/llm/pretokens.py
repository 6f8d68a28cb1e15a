"""Split text into pre-tokens and encode single pre-tokens, inside tasks."""

from __future__ import annotations

import functools
import json
import os
import re

import regex
import tiktoken
from tokenizers import Tokenizer

# Blocks whose letters, digits and spaces are the same in every Unicode version
# that the tokenizer libraries in use follow (Latin, Greek and Cyrillic basics, general
# punctuation, kana, common ideographs, hangul).
STABLE = (
    "\u0000-ɏΑ-ΡΣ-ώЀ-ҁא-תء-غف-ي٠-٩"
    "अ-हก-ะḀ-ẛ -​‐-‧ -⁞€←-⇿∀-⋿"
    "　-〃ぁ-ゖァ-ヺ一-龥가-힣！-～\U0001f600-\U0001f64f"
)
UNSTABLE = re.compile(f"[^{STABLE}]")


# On texts of these characters only, the split pattern of public byte-level
# vocabularies means the plain classes below, which the standard library matches twice as fast.
PLAIN = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ɏ]")
PLAIN_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_PATTERN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{PLAIN_LETTERS}]+| ?[0-9]+| ?[^\s{PLAIN_LETTERS}0-9]+|\s+(?!\S)|\s+")
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(pattern: str, by_ranks: bool = False):
    """A function that gives the matches of ``pattern`` in a text, with white space as Unicode
    defines it, not as Python does. ``by_ranks``: letters and digits are those of the library of rank
    files, which may follow another Unicode version."""
    general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    spans, general = general.finditer, general.findall
    plain, other, unstable = PLAIN_PATTERN.findall, PLAIN.search, UNSTABLE.search
    known = pattern == SPLIT_PATTERN

    def find(text: str) -> list[str]:
        if known and not other(text):
            return plain(text)
        if not by_ranks or not unstable(text):
            return general(text)
        return [text[m.start() : m.end()] for m in spans(text.translate(stand_ins()))]

    return find


@functools.cache
def stand_ins() -> dict[int, str]:
    """For each character whose class here is not that of the library of rank files, one that has its
    class in both: a letter, a digit or neither. The library itself tells the classes."""
    whole = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    out = {}
    for kind in (r"\p{L}", r"\p{N}"):
        bare = tiktoken.Encoding("bare", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs, ours = set(bare.decode_bytes(bare.encode_ordinary(whole)).decode()), set(regex.findall(kind, whole))
        out |= {ord(x): "\ue000" for x in ours - theirs if ord(x) not in out}
        out |= {ord(x): "é" if kind == r"\p{L}" else "²" for x in theirs - ours}
    return out


class PretokenEncoder:
    """Ids of texts as a byte-level tokenizer gives them, one pre-token at a time.

    A text is encoded whole by the library when it holds a special string, or a character whose
    class may differ between Unicode versions. ``known`` (frequent pre-tokens) is only read;
    ``cache`` grows up to ``cache_size`` short pre-tokens. ``value`` turns a list of ids into what
    is kept per pre-token.
    """

    LONGEST_CACHED = 64

    def __init__(self, tokenizer_json: str, pattern: str, value, known: dict | None = None, cache_size: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.value, self.known, self.cache, self.cache_size = value, known or {}, {}, cache_size
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.find = splitter(pattern)
        self.letters = byte_letters()
        spec = json.loads(tokenizer_json)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (spec.get("normalizer") is None and split.get("type") == "ByteLevel"
                        and split.get("use_regex", True) and not split.get("add_prefix_space", True))
        self.specials = [x["content"] for x in spec.get("added_tokens") or []]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def splits(self, text: str) -> bool:
        """Whether pre-tokens of ``text`` may be encoded apart."""
        return self.by_word and not UNSTABLE.search(text) and not any(s in text for s in self.specials)

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token, straight from the library's merge model."""
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its pre-tokens in order."""
        cache, value = self.cache, self.value
        first = (self.known or cache).get
        out = []
        for text in texts:
            if not self.splits(text):
                out.append([value(self.whole(text))])
                continue
            words = self.find(text)
            found = list(map(first, words))
            if None in found:
                for i, v in enumerate(found):
                    if v is None:
                        w = words[i]
                        v = cache.get(w)
                        if v is None:
                            v = value(self.word(w))
                            if len(cache) < self.cache_size and len(w) <= self.LONGEST_CACHED:
                                cache[w] = v
                        found[i] = v
            out.append(found)
        return out


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder_of(shared: dict, pattern: str, value) -> PretokenEncoder:
    """The encoder of this worker process. ``shared`` is a broadcast dictionary (``json``, ``known``,
    ``cache_size``) that lives as long as the worker, so that its cache serves all its tasks."""
    if "encoder" not in shared:
        shared["encoder"] = PretokenEncoder(shared["json"], pattern, value, shared["known"], shared["cache_size"])
    return shared["encoder"]
