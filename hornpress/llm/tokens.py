"""What the tokenizer operators share: the vocabulary file, word splitting and id pieces."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa

DEFAULT_FILE = "byte_bpe_50k.json"
#: Splits as the byte-level pre-tokenizer does.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are split with PATTERN here; others (letters that newer or older
#: Unicode tables class otherwise) by the library's own splitter.
AGREED = r"\u0000-՗ഀ-₎₠-ꟍ가-\U000107ba\U0001e700-\U0002b739"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def read_file(path: str) -> str:
    """The tokenizer file's text, read where the query is planned and sent along with the functions."""
    return Path(path).read_text(encoding="utf-8")


def version_digest(spec: str) -> str:
    return hashlib.sha256(spec.encode("utf-8")).hexdigest()


def tokenizer(spec: str):  # noqa: ANN201
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def added_tokens(spec: str) -> list[str]:
    """The added tokens, longest first, of a tokenizer whose texts Splitter can split."""
    conf = json.loads(spec)
    pre = conf["pre_tokenizer"]
    plain = not conf["normalizer"] and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
    simple = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in conf["added_tokens"])
    if not (plain and simple):
        raise ValueError("only byte-level tokenizers without a normalizer are supported")
    if any(" " in a["content"] for a in conf["added_tokens"]):
        raise ValueError("added tokens with spaces are not supported")
    return [a["content"] for a in sorted(conf["added_tokens"], key=lambda a: -len(a["content"]))]


#: Characters of a text that are split at once.
CHUNK = 1 << 20


class Splitter:
    """Whole texts to words that the tokenizer encodes one by one as it does within the text.

    Added tokens (such as <|endoftext|>) are words of their own.
    """

    def __init__(self, added: list[str]) -> None:
        import regex

        self.added, self.pre = set(added), None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.words = regex.compile(PATTERN).findall
        # added tokens hold no space, so that none is cut
        self.safe = regex.compile(r"[a-z] (?=[a-z])").search
        self.odd = regex.compile(f"[^{AGREED}]").search

    def _part(self, text: str) -> list[str]:
        if self.odd(text):
            if self.pre is None:
                from tokenizers import pre_tokenizers

                self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return self.words(text)

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The words of a text of any length, some CHUNK characters at a time.

        Between a letter and a single space before another letter a word always ends, so cutting
        there changes nothing. Without such a place the chunk goes on.
        """
        at = 0
        while len(text) - at > CHUNK:
            cut = self.safe(text, at + CHUNK)
            if cut is None:
                break
            yield self(text[at : cut.start() + 1])
            at = cut.start() + 1
        yield self(text[at:])

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(a in text for a in self.added):
            return self._part(text) if text else []
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.added else self._part(part))]


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pieces(spec: str) -> pa.Array:
    """The bytes of each id; ids without a piece have none."""
    conf, to_byte = json.loads(spec), byte_alphabet()
    table = {i: bytes(to_byte[c] for c in token) for token, i in conf["model"]["vocab"].items()}
    table |= {a["id"]: a["content"].encode("utf-8") for a in conf["added_tokens"]}
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], type=pa.large_binary())
