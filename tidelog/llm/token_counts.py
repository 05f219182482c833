"""Operator 8: word-piece counts by a linear longest-match automaton.

Greedy word-pieces take the longest vocabulary piece that starts the rest of the word, again and again.
The automaton reads each byte once: where the trie can't go on, the node's failure link leads to the node
that greedy matching would stand on after popping the pieces matched so far, and the node stores how many
those are. Pieces themselves are never built. (Linear-time WordPiece as published by Song et al., 2021.)
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import modest_batches

#: Words whose counts a Python worker keeps; the store starts anew beyond.
KEPT_WORDS = 500_000
FAIL = -1


class Automaton(dict):
    """automaton[word] is the number of greedy pieces of a word; a dict of the words seen so far.

    initial: pieces that may begin a word; inner: pieces that may follow. An empty initial piece counts as
    one and lets inner pieces follow where no longer one fits. A word that can't be covered whole counts as
    `unknown` pieces.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes], unknown: int = 1):
        super().__init__()
        self.unknown = unknown
        self.next: list[dict[int, int]] = [{}, {}]  # node 0 begins a word, node 1 begins an inner piece
        self.ends = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for p in pieces:
                if p or root == 0:
                    self._add(root, p)
        self._link()

    def _add(self, root: int, piece: bytes) -> None:
        node = root
        for b in piece:
            if b not in self.next[node]:
                self.next[node][b] = len(self.next)
                self.next.append({})
                self.ends.append(False)
            node = self.next[node][b]
        self.ends[node] = True

    def _link(self) -> None:
        """Failure links and popped counts, breadth first: a node that ends a piece pops it and stands at
        node 1; any other follows its parent's links until one can read the node's byte."""
        n = len(self.next)
        self.fail, self.popped = [FAIL] * n, [0] * n
        if self.ends[0]:  # an empty initial piece
            self.fail[0], self.popped[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for b, v in self.next[u].items():
                if self.ends[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, count = self.fail[u], self.popped[u]
                    while z != FAIL and b not in self.next[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z != FAIL:
                        self.fail[v], self.popped[v] = self.next[z][b], count
                todo.append(v)

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        node = total = 0
        nexts, fail, popped = self.next, self.fail, self.popped
        for b in word:
            while (to := nexts[node].get(b)) is None:
                total += popped[node]
                node = fail[node]
                if node == FAIL:
                    return self.unknown
            node = to
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node == FAIL:
                return self.unknown
        return total

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = n = self.count(word)
        return n


def byte_level_pieces(json_path: str, lone_blank: bool = False) -> tuple[list[bytes], list[bytes]]:
    """(initial, inner) pieces of a byte-level vocabulary, as bytes: those with a blank in front begin words.
    With lone_blank the vocabulary's blank alone is among them, as an empty piece."""
    with open(json_path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # the byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    pieces = [bytes(back[c] for c in p) for p in vocabulary if all(c in back for c in p)]
    return [p[1:] for p in pieces if p[:1] == b" " and (lone_blank or len(p) > 1)], [p for p in pieces if p[:1] != b" "]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_automata: dict[tuple[str, bool], Automaton] = {}


def automaton(json_path: str, lone_blank: bool = False) -> Automaton:
    key = json_path, lone_blank
    if key not in _automata:
        _automata[key] = Automaton(*byte_level_pieces(*key))
    return _automata[key]


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lone_blank: bool = False) -> DataFrame:
    """(doc_id, n_words, n_pieces, longest) for each row of docs: words, their word-pieces, most in one word.

    Words are runs of anything but ASCII white space, cut into UTF-8 bytes; a word's first piece is one that
    the vocabulary has with a blank in front, later ones are those without. lone_blank=True, as in the query,
    lets the blank piece alone begin a word (one piece) where no longer one fits, so that a vocabulary with
    all single bytes covers every word. A word that can't be covered is one piece. Null and empty texts have
    none; an empty table gives no rows. Every row, repeated or not, is counted on its own, however long; other
    columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(path, lone_blank)
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for text in b.column(1):
                value = text.as_py()
                each = list(map(known.__getitem__, value.encode().split())) if value else []
                out.append((len(each), sum(each), max(each, default=0)))
            words, pieces, longest = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64()), pa.array(longest, pa.int64())], names=["doc_id", "n_words", "n_pieces", "longest"])

    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_pieces long, longest long")


def oracle(json_path: str) -> str:
    """SQL for token_counts(lone_blank=True) over documents, with the pieces of the byte-level vocabulary at
    json_path as hex digits; a word is cut with a blank in front of it."""
    return f"""
WITH RECURSIVE alphabet AS (
  SELECT CASE WHEN own THEN chr(b) ELSE chr(255 + CAST(count(*) FILTER (NOT own) OVER (ORDER BY b) AS INTEGER)) END AS letter, printf('%02X', b) AS byte
  FROM (SELECT CAST(b AS INTEGER) AS b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 AS own FROM range(256) r(b))),
entries AS (SELECT unnest(json_keys(content, '$.model.vocab')) AS entry FROM read_text('{json_path}')),
spelt AS (SELECT entry, unnest(string_split(entry, '')) AS letter, unnest(range(length(entry))) AS pos FROM entries),
pieces AS (SELECT string_agg(byte, '' ORDER BY pos) AS piece FROM spelt LEFT JOIN alphabet USING (letter) GROUP BY entry HAVING count(*) = count(byte)),
sizes AS (SELECT piece, strlen(piece) // 2 AS size FROM pieces WHERE piece <> ''),
longest AS (SELECT max(size) AS most FROM sizes),
d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT k, unnest(words) AS word FROM d),
spaced AS (SELECT word, '20' || hex(encode(word)) AS bytes FROM (SELECT DISTINCT word FROM w)),
cut AS (
  SELECT word, bytes, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n FROM spaced
  UNION ALL
  SELECT word, any_value(bytes), pos + max(size), any_value(n) + 1
  FROM (SELECT c.*, unnest(range(1, least((SELECT most FROM longest), strlen(bytes) // 2 - pos) + 1)) AS length FROM cut c WHERE pos * 2 < strlen(bytes)) x
  JOIN sizes ON piece = substring(bytes, 2 * pos + 1, 2 * length)
  WHERE pos = 0 OR piece[1:2] <> '20' GROUP BY word, pos),
counted AS (SELECT word, coalesce(max(n) FILTER (pos * 2 = strlen(bytes)), 1) AS n FROM cut GROUP BY word),
sums AS (SELECT k, count(*) AS n_words, sum(n) AS n_pieces, max(n) AS longest FROM w JOIN counted USING (word) GROUP BY k)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_pieces, 0) AS BIGINT) AS n_pieces, coalesce(longest, 0) AS longest FROM d LEFT JOIN sums USING (k)
"""
