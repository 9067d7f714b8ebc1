"""Encoding with public tokenizer files, piece by piece where that is exact."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: A single space between two characters that are no white space starts a new piece in every byte-level tokenizer whose
#: pattern takes " word" as one piece and never white space inside one, so a text may be cut there.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than spaces and line ends.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Pieces that a worker remembers before it forgets them all.
REMEMBERED = 600_000
#: Longest piece that is remembered, in characters.
LONGEST = 64


@lru_cache(maxsize=4)
def encoder_for(path: str, pattern: str | None = None) -> PieceEncoder:
    """The encoder of a file, made once in a process: workers serve many tasks."""
    return PieceEncoder(path, pattern)


class PieceEncoder:
    """Token ids of whole texts as the library for the file gives them, without special tokens of its own.

    Files: ``.json`` (tokenizers), ``.model`` (sentencepiece), ``.tiktoken`` (ranks, with ``pattern``). Special
    strings inside texts are handled as the library's default for the file: known ones become their ids for
    ``.json``; ``.tiktoken`` and ``.model`` take them as ordinary text.
    """

    def __init__(self, path: str, pattern: str | None = None):
        self.memory: dict[str, bytes] = {}
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                made = json.load(f)
            pre = made.get("pre_tokenizer") or {}
            added = [a for a in made.get("added_tokens", []) if a.get("lstrip") or a.get("rstrip") or re.search(r"\s", a["content"])]
            self.by_piece = (
                pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and not made.get("normalizer") and not made.get("post_processor") and not added
            )
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.n_ids = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            begins = [i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t[0] == "Ġ"]  # a space in byte-level vocabularies
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_piece, self.n_ids, begins = False, model.get_piece_size(), []
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            import base64

            import tiktoken

            if pattern is None:
                import public_tokenizers

                pattern = public_tokenizers.PATTERN
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.by_piece, self.n_ids, begins = False, max(ranks.values()) + 1, []  # whole texts are faster here
            self.encode = lambda texts: [coder.encode_ordinary(t) for t in texts]
        self.begins = np.zeros(self.n_ids, bool)
        self.begins[begins] = True

    def pieces(self, text: str) -> list[str]:
        """The text cut at safe spaces, which are left out: each piece but the first begins with one."""
        plain = text[:1] != " " and text[-1:] != " " and "  " not in text and " \n" not in text and "\n " not in text
        return text.split(" ") if plain and not OTHER_SPACE.search(text) else CUT.split(text)

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces, each with its space in front; many at once, told apart by the tokens that begin with a space."""
        out: dict[str, bytes] = {}
        plain = [p for p in pieces if " " not in p]
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            ids = np.array(self.encode([" " + " ".join(some)])[0], "<i4")
            at = np.flatnonzero(self.begins[ids]) * 4
            if len(at) != len(some):  # a vocabulary with other habits
                out |= {p: np.array(x, "<i4").tobytes() for p, x in zip(some, self.encode([" " + p for p in some]), strict=True)}
                continue
            raw = ids.tobytes()
            ends = [*at[1:].tolist(), len(raw)]
            out.update(zip(some, (raw[a:b] for a, b in zip(at.tolist(), ends, strict=True)), strict=True))
        other = [p for p in pieces if " " in p]
        out |= {p: np.array(x, "<i4").tobytes() for p, x in zip(other, self.encode([" " + p for p in other]), strict=True)}
        return out

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit numbers."""
        if not self.by_piece:
            return [np.array(self.encode([t])[0] if t else [], "<i4").tobytes() for t in texts]
        cut = [self.pieces(t or "") for t in texts]
        heads = [np.array(x, "<i4").tobytes() for x in self.encode([c[0] for c in cut])]
        tails = [c[1:] for c in cut]
        memory = self.memory
        new = set(chain.from_iterable(tails)).difference(memory)
        made = self._encode_pieces(list(new))
        if len(memory) + len(made) > REMEMBERED:
            # what this call needs stays at hand, the rest is forgotten
            made |= {p: memory[p] for p in chain.from_iterable(tails) if p in memory}
            memory.clear()
            get = made.__getitem__
        elif max(map(len, new), default=0) > LONGEST:
            get = (memory | made).__getitem__
        else:
            memory.update(made)
            get = memory.__getitem__
        return [head + b"".join(map(get, tail)) for head, tail in zip(heads, tails, strict=True)]

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(x) // 4 for x in self.ids_of(texts)]
