"""Token counts by dynamic programming shared through a trie of pre-tokens.

A unigram tokenizer's forward pass gives each prefix of a word the score of its best
segmentation; the tokens of the best one are what the tokenizer would emit.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import for_python, small

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
#: Log probability of each byte of a character that is no piece: one byte token each.
BYTE = -20.0
#: Characters of pre-tokens that a task's trie holds before it starts anew; counts don't depend on it.
NODES = 800_000


def pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Piece to log probability: Zipf's law over the order of the vocabulary's own scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    own = sorted((i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))), key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(own))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(own)}


def ends(scores: dict[str, float]) -> dict[str, float | None]:
    """Pieces to their scores, and all other ends of pieces to None: where a search backwards may go on."""
    return {p[i:]: None for p in scores for i in range(1, len(p))} | scores


class Trie(dict):
    """Pre-token to token count: the terminals of the trie, filled as they are asked for.

    A node is a prefix: the best score over its segmentations into pieces, and the tokens of
    the best one (of equal scores, the fewer tokens). It is computed from the nodes above it,
    once, whatever the number of pre-tokens that share it. Nodes are numbered; ``below`` leads
    from a node and a character to the next.
    """

    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        super().__init__()
        self.table, self.most, self.computed = ends(scores), nodes, 0
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.below: dict[int, int] = {}
        self.score, self.count = array("d", [0.0]), array("l", [0])

    def _step(self, word: str, end: int, above: list[tuple[float, int]]) -> tuple[float, int]:
        """Forward score and tokens of word[:end] from those of its shorter prefixes."""
        get = self.table.get
        p = get(word[end - 1])
        used = 1
        if p is None:
            used = len(word[end - 1].encode("utf-8", "surrogatepass"))
            p = BYTE * used
        best, count = above[end - 1][0] + p, above[end - 1][1] + used
        for begin in range(end - 2, -1, -1):
            p = get(word[begin:end], 1.0)
            if p is None:
                continue
            if p > 0:  # no piece ends so
                break
            score = above[begin][0] + p
            if score > best or (score == best and above[begin][1] < count - 1):
                best, count = score, above[begin][1] + 1
        self.computed += 1
        return best, count

    def __missing__(self, word: str) -> int:
        if len(self.score) > self.most or len(self) > self.most:
            self._reset()
        marked = START + word
        node, above, below = 0, [(0.0, 0)], self.below
        for end in range(1, len(marked) + 1):
            way = node << 21 | ord(marked[end - 1])
            node = below.get(way, 0)
            if not node:
                score, count = self._step(marked, end, above)
                node = below[way] = len(self.score)
                self.score.append(score)
                self.count.append(count)
                above.append((score, count))
            else:
                above.append((self.score[node], self.count[node]))
        self[word] = above[-1][1]
        return self[word]


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row: whole texts, pre-tokens split at white space.

    Null, empty or blank text has no tokens. Repeated rows give repeated results, an empty
    table an empty result; other columns are ignored. There is no shuffle: each task has a
    trie of its own, of bounded size, over the pre-tokens of its rows.
    """
    for_python(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(pieces(path))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shipped.value)
        of = trie.__getitem__
        for b in small(batches):
            found = [(t.as_py() or "").split() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, found), pa.int64()), pa.array((sum(map(of, x)) for x in found), pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
