"""Batch encoding with the ``tokenizers`` library inside Arrow functions.

A byte-level BPE never merges across the matches of its split pattern, and a match never continues from a
non-space character into white space. So every change from a non-space to a space character is a *safe
boundary*: the tokens of a text are the tokens of its segments between safe boundaries, one after the
other. Texts are cut there, each distinct segment of a batch is encoded once (``encode_batch_fast``), and
a memo of bounded size keeps the result for the following batches of the task; the full memo before it is asked for what
it lacks, so that frequent segments are not encoded again whenever it starts anew.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

# White space of the split pattern (Unicode White_Space; fixed values). Python's own \\s also has \\x1c-\\x1f.
WHITE = (" \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
BATCH_CHARS = 1 << 20      # segments are looked up for texts of about this size together
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # ASCII punctuation of a word's end; no apostrophe, no <|>
# A line end or nothing, letters up to U+024F (those that Python calls letters), punctuation; no letters for other segments.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
LATIN = re.compile(f"(\0\n)?(?:([{_LETTERS}]+)([{re.escape(TAIL)}]*)$(?!\n))?").match
JOIN_CHARS = 10_000        # new segments are encoded as strings of about this length
MEMO_SEGMENTS = 500_000    # segments kept per worker, and as many of the memo before
MEMO_CHARS = 64            # longer segments are encoded whenever they occur


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters stand for themselves, the
    other bytes, in order, for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


def load_tokenizer(path: str):
    """The tokenizer of a ``.json`` file, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    tk.no_padding()
    return tk


def per_worker(key: tuple, make):
    """What ``make()`` gives, made once per Python worker process. Workers serve many tasks; this package comes to
    them by value with every task, so its own globals would not last."""
    import sys
    import types
    kept = sys.modules.setdefault("quarry_worker_kept", types.ModuleType("quarry_worker_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def encoder(path: str, ids: bool = False, batch_chars: int = BATCH_CHARS) -> "SegmentEncoder":
    """A segment encoder for a byte-level ``.json`` file. Added tokens are written as they are, other
    tokens with one character for each byte. Tokenizer and memo are those of the worker: tasks add to one memo."""
    return per_worker(("encoder", path, ids, batch_chars), lambda: _encoder(path, ids, batch_chars))


def _encoder(path: str, ids: bool, batch_chars: int) -> "SegmentEncoder":
    tk = load_tokenizer(path)
    added = tk.get_added_tokens_decoder()
    plain = tk.normalizer is None and type(tk.pre_tokenizer).__name__ == "ByteLevel" and not tk.pre_tokenizer.add_prefix_space \
        and tk.pre_tokenizer.use_regex and not any(t.content.strip(TAIL).isalpha() for t in added.values() if t.content[0] not in TAIL)
    return SegmentEncoder(tk, lambda token, i: len(token.encode()) if i in added else len(token), ids, batch_chars, words=plain)


class SegmentEncoder:
    """Encodes texts by segments; per text gives the number of tokens, or (``ids``) the ids as bytes.

    ``token_bytes(id)`` is a token's length in bytes. New segments are encoded joined to long strings (again
    safe: each ends with a non-space and the next begins with a space) and told apart by their lengths."""

    def __init__(self, tokenizer, token_bytes, ids: bool = False, batch_chars: int = BATCH_CHARS,
                 memo_segments: int = MEMO_SEGMENTS, words: bool = False):
        self.tokenizer, self.ids, self.batch_chars, self.memo_segments = tokenizer, ids, batch_chars, memo_segments
        self.size = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            self.size[i] = token_bytes(token, i)
        self.memo = {}  # segment -> kept; spaced segments are kept without their space, raw ones after "\0"
        self.before = {}  # the memo that was full before this one: what is still met goes over
        self.cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.unsafe = re.compile(f"[{WHITE}] |\0").search
        self.unsafe_line = re.compile(f"[{WHITE}]\n|\n[{WHITE}]").search
        self.white = frozenset(WHITE)
        self.rare = "\0" + "".join(c for c in WHITE if c not in " \n")
        self.words = words
        self.merge, self.tails = tokenizer.model.tokenize, {"": []}
        self.shown = {b: c for b, c in enumerate(byte_chars())}
        self.space = self.shown[32]
        self.line_end = [t.id for t in self.merge(self.shown[10])] if words else []

    def segments(self, text: str) -> list[str]:
        """Keys of the text's segments. Where every space follows a non-space character, plain spaces are
        the boundaries, and line ends where all stand alone (other white space stays inside segments); else every
        safe boundary is."""
        if not text:
            return []
        lines = "\n" in text
        if any(map(text.__contains__, self.rare)):
            unsafe, lines = self.unsafe(text), lines and not self.unsafe_line(text)
        else:  # the same, where spaces and line ends are the only white space: single characters are found much faster
            unsafe, lines = "  " in text or "\n " in text, lines and " \n" not in text and "\n\n" not in text
        if unsafe:
            return ["\0" + x for x in self.cut(text)]
        if lines:
            text = text.replace("\n", " \0\n")
        out = text.split(" ")
        if out[0]:
            out[0] = "\0" + out[0]
            return out
        del out[0]
        return out

    @staticmethod
    def text_of(key: str) -> str:
        return key[1:] if key[:1] == "\0" else " " + key

    def word_ids(self, key: str) -> list[int] | None:
        """Ids of a space or a line end, Latin letters and ASCII punctuation after them, or None for any other segment.

        These are matches of the split pattern (letters with their space, a single line end, punctuation), whatever
        the Unicode version, so the model's merges are asked for directly."""
        line, word, tail = LATIN(key).groups()
        if not word:
            return None
        if tail not in self.tails:
            self.tails[tail] = [t.id for t in self.merge(tail)]
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        if line:
            return self.line_end + [t.id for t in self.merge(shown)] + self.tails[tail]
        return [t.id for t in self.merge(self.space + shown)] + self.tails[tail]

    def learn(self, keys: list[str]) -> None:
        """Encode segments that the memo lacks."""
        joined, alone, size, part = [], [], 0, []
        for k in keys:
            if self.words and len(k) <= MEMO_CHARS and (ids := self.word_ids(k)) is not None:
                self.memo[k] = array("I", ids).tobytes() if self.ids else len(ids)
                continue
            t = self.text_of(k)
            if t[0] in self.white and t[-1] not in self.white:
                part.append((k, t))
                size += len(t)
                if size > JOIN_CHARS:
                    joined.append(part)
                    part, size = [], 0
            else:
                alone.append([(k, t)])
        groups = joined + ([part] if part else []) + alone
        got = self.tokenizer.encode_batch_fast(["".join(t for _, t in g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, got):
            ids = np.array(e.ids, "<u4")
            if len(g) == 1:
                cuts = [0, len(ids)]
            else:
                ends = np.cumsum([len(t.encode()) for _, t in g])
                cuts = [0, *(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1).tolist()]
            raw = ids.tobytes() if self.ids else None
            for (k, _), a, b in zip(g, cuts, cuts[1:]):
                self.memo[k] = raw[4 * a:4 * b] if self.ids else b - a

    def batches(self, texts):
        """Lists of texts of about ``batch_chars`` together (a longer text is alone)."""
        part, size = [], 0
        for t in texts:
            if part and size + len(t) > self.batch_chars:
                yield part
                part, size = [], 0
            part.append(t)
            size += len(t)
        if part:
            yield part

    def map(self, texts):
        """For every text its number of tokens, or its ids as bytes."""
        for part in self.batches(texts):
            if len(self.memo) > self.memo_segments:
                self.memo, self.before = {}, self.memo
            cut = [self.segments(t) for t in part]
            flat = [k for keys in cut for k in keys]
            kept = list(map(self.memo.get, flat))
            missing = [i for i, v in enumerate(kept) if v is None]
            if missing:
                new = dict.fromkeys([flat[i] for i in missing])
                if self.before:
                    known = {k: v for k in new if (v := self.before.get(k)) is not None}
                    self.memo.update(known)
                    new = [k for k in new if k not in known]
                self.learn(list(new))
                for i in missing:
                    kept[i] = self.memo[flat[i]]
                for k in new:
                    if len(k) > MEMO_CHARS:
                        del self.memo[k]
            at = 0
            for keys in cut:
                own = kept[at:at + len(keys)]
                at += len(keys)
                yield b"".join(own) if self.ids else sum(own)
