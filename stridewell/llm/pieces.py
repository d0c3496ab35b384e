"""SentencePiece encoding by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Entries of a task's tables of words and of pairs; a full table starts anew.
WORDS, PAIRS = 200_000, 1 << 20
#: Longer words aren't kept.
LONGEST = 48
#: Characters of a text that are encoded at a time, and on to the end of the word.
SLICE = 1 << 20


class Vocabulary:
    """Pieces of a BPE model with byte fallback, the order in which they merge, and an automaton that finds them."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n = sp.get_piece_size()
        self.pieces = ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(self.n)]
        self.size = list(map(len, self.pieces))
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.surface = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        plain = [i for i, p in enumerate(self.pieces) if p and not sp.is_byte(i)]
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.pieces[i]: order[sp.get_score(i)] for i in plain}
        self.never = len(order)
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces that reach beyond a word aren't supported")
        signs = {c for p in self.rank for c in p}
        stops = "".join(c for c in "\n\r\t" if c not in signs)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{stops}]+|{SPACE}+" + f"|[{stops}]" * bool(stops))
        self._grow(plain)
        self.pairs: dict[int, bool] = {}
        self.stages: dict[int, list[tuple[int, str, str]]] = {}

    def _grow(self, plain: list[int]) -> None:
        """Aho and Corasick's automaton: children and the longest proper suffix of each state, and the pieces that end there, the longest first."""
        self.children, self.suffix, self.ends = [{}], [0], [()]
        for i in plain:
            state = 0
            for c in self.pieces[i]:
                if (after := self.children[state].get(c)) is None:
                    after = self.children[state][c] = len(self.children)
                    self.children.append({})
                    self.suffix.append(0)
                    self.ends.append(())
                state = after
            self.ends[state] = (i,)
        level = list(self.children[0].values())
        while level:
            deeper = []
            for state in level:
                self.ends[state] += self.ends[self.suffix[state]]
                for c, after in self.children[state].items():
                    self.suffix[after] = self.step(self.suffix[state], c)
                    deeper.append(after)
            level = deeper

    def step(self, state: int, c: str) -> int:
        while (after := self.children[state].get(c)) is None and state:
            state = self.suffix[state]
        return after or 0

    def alone(self, piece: int) -> list[tuple[int, str, str]]:
        """How a piece comes about from its characters: before each merge its rank and the first and last part, and these of the end."""
        if (found := self.stages.get(piece)) is None:
            parts, found = list(self.pieces[piece]), []
            while True:
                ranks = [self.rank.get(a + b, self.never) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(ranks, default=self.never)
                found.append((best, parts[0], parts[-1]))
                if best == self.never:
                    break
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) > 1:
                found = []  # it never comes about
            self.stages[piece] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b come about where their characters meet: no merge across is the best one at any time.

        Of merges of one rank the leftmost comes first.
        """
        left, right, rank, i, j = self.alone(a), self.alone(b), self.rank, 0, 0
        if not left or not right:
            return False
        while True:
            x, y = left[i][0], right[j][0]
            across = rank.get(left[i][2] + right[j][1], self.never)
            if across < x and across <= y and across < self.never:
                return False
            if x == y == self.never:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def encode(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        """The ids of each word (a text without spaces inside) of a sorted list.

        Each prefix has one last token: the piece that ends there and is compatible with the last token of the prefix
        before it. A character that no piece holds has none; its bytes stand for it, and nothing merges with it. The
        table of prefixes is kept as far as the next word begins alike.
        """
        pairs, n, size, children, suffix, ends = self.pairs, self.n, self.size, self.children, self.suffix, self.ends
        states, last, past = [0], [-1], ""
        for word in words:
            shared, most = 0, min(len(past), len(word))
            while shared < most and past[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state, past = states[shared], word
            for at in range(shared, len(word)):
                c = word[at]
                while (after := children[state].get(c)) is None and state:
                    state = suffix[state]
                state = after or 0
                states.append(state)
                token = -1
                for piece in ends[state]:
                    pair = last[at + 1 - size[piece]] * n + piece
                    if (fits := pairs.get(pair)) is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = bool(self.alone(piece)) if pair < 0 else self.compatible(pair // n, piece)
                    if fits:
                        token = piece
                        break
                last.append(token)
            ids, at = [], len(word)
            while at:
                if (piece := last[at]) >= 0:
                    ids.append(piece)
                    at -= size[piece]
                else:
                    ids += [self.bytes.get(b, self.unknown) for b in reversed(word[at - 1].encode())]
                    at -= 1
            yield tuple(reversed(ids))


class Coder:
    """Encodes and decodes texts with a model file, as the sentencepiece library does."""

    def __init__(self, model: str, end: bool = True):
        self.v, self.end = Vocabulary(model), end
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _known(self, slices: list[list[str]]) -> dict[str, tuple[int, ...]]:
        """The ids of all words of some slices of texts. Words of the last WORDS new ones are remembered."""
        found = {w: self.kept.get(w) or self.older.get(w) for w in set(chain.from_iterable(slices))}
        new = sorted(w for w, ids in found.items() if ids is None)
        for word, ids in zip(new, self.v.encode(new), strict=True):
            found[word] = ids
            if len(word) <= LONGEST:
                if len(self.kept) >= WORDS:
                    self.kept, self.older = {}, self.kept
                self.kept[word] = ids
        return found

    def _slices(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """The words of each text, with its number, some SLICE characters at a time. A text that isn't empty gets a space before it."""
        for i, text in enumerate(texts):
            if not text:
                yield i, []
                continue
            marked = SPACE + text.replace(" ", SPACE)
            if len(marked) <= SLICE:
                yield i, self.v.words.findall(marked)
                continue
            words, size = [], 0
            for m in self.v.words.finditer(marked):
                words.append(m[0])
                size += len(m[0])
                if size >= SLICE:
                    yield i, words
                    words, size = [], 0
            yield i, words

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as int32; of a null or empty one none but the end id."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            known = self._known([words for _, words in held])
            for i, words in held:
                out[i].append(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32))
            held.clear()

        for i, words in self._slices(texts):
            held.append((i, words))
            size += len(words)
            if size >= SLICE // 4:
                flush()
                size = 0
        flush()
        last = [np.array([self.v.end] * self.end, np.int32)]
        return [np.concatenate(parts + last) for parts in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that `encode` gave."""
        return b"".join(map(self.v.surface.__getitem__, ids.tolist())).decode(errors="replace").removeprefix(" ")


def encode(docs: DataFrame, model: str | None = None, end: bool = True) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (the text that the ids give) of every whole text.

    model is a file that every executor has. A null or empty text has the end id alone, and decodes to an empty one.
    Repeated rows and null doc_ids are rows of their own; other columns are ignored; an empty table gives an empty one.
    A map stage alone: a task holds a batch of some 4 MB of text, or one longer text with its ids, and tables of bounded size.
    """
    import public_tokenizers

    model = model or public_tokenizers.path("piece_bpe_32k.model")
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and the tables are many small objects
        coder = Coder(model, end)
        for b in batches:
            ids = coder.encode(b.column(1).to_pylist())
            if not ids:
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(map(coder.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 of what `encode` gives."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
