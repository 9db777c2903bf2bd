"""Word-piece token counts by a linear longest-match automaton.

The vocabulary, a set of word-initial pieces and a set of inner pieces, becomes
a trie.  Every node has a failure link, the node to go on from when no child
fits, and the number of pieces that are finished on the way there.  A word is
then read once, byte by byte, and the counts of finished pieces are added: the
greedy longest-match length, without any piece being built.  A word that some
place cannot match counts as one unknown token.

Text is split into words by the white space of ASCII and into runs of letters,
digits and marks, and single other characters.  Words are ordinary text: no
special tokens.  A null or empty text has 0 words and 0 tokens.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logprism.llm.common import arrow_rows

#: Default vocabulary; the path is a parameter of every function that reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
UNITS = re.compile(r"\w+|[^\w\s]")
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
COUNTS_DDL = "doc_id long, n_words long, n_tokens long"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_pieces(path: str = VOCABULARY) -> tuple[set[bytes], set[bytes]]:
    """Word-initial and inner pieces of a byte-level vocabulary file.

    Entries that begin with a space are word-initial, without it; the others
    are inner pieces.  Single bytes are both, so every word can be matched.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    first, inner = set(), set()
    for entry in vocabulary:
        if all(c in letters for c in entry):
            piece = bytes(letters[c] for c in entry)
            if piece[:1] == b" ":
                first.add(piece[1:])
            else:
                inner.add(piece)
    single = {bytes([b]) for b in range(256)}
    return (first | single) - {b""}, (inner | single) - {b""}


class Automaton:
    """Trie with failure links and counts of finished pieces.

    Node 0 is where a word begins, node 1 where an inner piece begins.
    """

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes]):
        self.next: dict[int, int] = {}
        self.fail, self.done = [-1, -1], [0, 0]
        ends = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in self.next:
                        self.next[key] = len(ends)
                        ends.append(False)
                    node = self.next[key]
                ends[node] = True
        self.fail += [-1] * (len(ends) - 2)
        self.done += [0] * (len(ends) - 2)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.next.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for byte, node in children.get(parent, ()):
                queue.append(node)
                if ends[node]:  # the whole path is a piece: finish it and begin an inner one
                    self.fail[node], self.done[node] = 1, 1
                    continue
                # finish what the parent can, then try to go on with this byte
                at, finished = self.fail[parent], self.done[parent]
                while at >= 0 and (at << 8 | byte) not in self.next:
                    finished += self.done[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.done[node] = self.next[at << 8 | byte], finished

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; 1 if it cannot be matched, 0 if it is empty."""
        go, fail, done = self.next, self.fail, self.done
        node, pieces = 0, 0
        for byte in word:
            while (node << 8 | byte) not in go:
                pieces += done[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = go[node << 8 | byte]
        while node > 1:  # the end of the word: finish what is left
            pieces += done[node]
            node = fail[node]
        return pieces if node == 1 else 1 if word else 0


class Counts(dict):
    """Word -> number of pieces; forgets its words when there are too many of them."""

    LIMIT = 1_000_000

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self.automaton.count(word.encode())
        if len(word) <= 100:
            self[word] = value
        return value


def token_counts(docs: DataFrame, pieces: tuple[set[bytes], set[bytes]] | None = None,
                 path: str = VOCABULARY, lower: bool = False) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of whole texts.

    The vocabulary's size bounds the automaton that tasks are given.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(pieces or word_pieces(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = Counts(Automaton(*automaton.value)).__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                found = UNITS.findall(text.lower() if lower else text)
                words.append(len(found))
                tokens.append(sum(map(of_word, found)))
            yield arrow_rows(COUNTS, [batch["doc_id"], words, tokens])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, COUNTS_DDL)
