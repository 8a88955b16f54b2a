import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from recollect.llm import align
from recollect.llm.queries import QUERIES

ODD = [
    (1, "a  b\t\tc\r\n d\r \n e"), (2, None), (3, ""), (4, " "), (5, "x▁y z"), (6, "<s> </s> <|endoftext|> <0x0A>"), (7, "\n\nfoo  bar \n"), (8, "日本語 テスト ok"), (9, "ab" * 5000),
    (10, "\r;\r foo;\r\n"), (None, "the the"), (None, "the the"), (12, "\x00 \x85 \x1c x y　 z"), (13, "😀 é ſ ǆ"), (14, "it's we'll 123 4 ..  .."),
]


@pytest.fixture(scope="module")
def brute():
    """The contract, read word by word: whole texts encoded, two pointers over the tokens' ends."""
    a_model, b_model = Tokenizer.from_file(align.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=align.PIECE_BPE)
    a_model.encode_special_tokens = True
    a_bytes, b_bytes = align.ByteBpe(align.BYTE_BPE).bytes, align.PieceBpe(align.PIECE_BPE).bytes

    def ends(ids, width):
        out = [0]
        for i in ids:
            out.append(out[-1] + len(width[i]))
        return out[1:]

    def of(rows):
        docs, counts = [], Counter()
        for doc_id, text in rows:
            a, b = (a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
            if text and not b"".join(map(a_bytes.__getitem__, a)) == b"".join(map(b_bytes.__getitem__, b)) == f" {text}".encode():
                a, b = [], []
            to_a, to_b = ends(a, a_bytes), ends(b, b_bytes)
            links, groups, own, i, j = [], [], ([], []), 0, 0
            while i < len(a):
                links.append((a[i], b[j]))
                x, y = to_a[i], to_b[j]
                if x <= y:
                    own[0].append(a[i])
                    i += 1
                if y <= x:
                    own[1].append(b[j])
                    j += 1
                if x == y:
                    groups.append(own)
                    own = ([], [])
            docs.append((doc_id, a, b, groups, links))
            counts.update(links)
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        rows = [(d, len(a), len(b), len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(text(g).encode()).hexdigest() if a else "") for d, a, b, g, ls in docs]
        return sorted(map(str, rows)), counts

    return of


def plain(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_the_whole_query_by_brute_force(spark, small, brute):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert plain(QUERIES["op11_alignment"](spark, small)) == brute(rows)[0]


def test_odd_texts_and_small_chunks(spark, brute, monkeypatch):
    """Blanks of all kinds, characters of many bytes, the pieces' own mark, texts of special tokens; a chunk a text."""
    expected, counts = brute(ODD)
    frame = spark.createDataFrame(ODD, "doc_id long, text string")
    found, pairs = align.align(frame)
    assert plain(found) == expected
    width = len(align.PieceBpe(align.PIECE_BPE).bytes)
    assert {(r.code // width, r.code % width): r.n for r in pairs.collect()} == counts
    chunks = align.chunked(frame.coalesce(1), align.BYTE_BPE, align.PIECE_BPE)
    assert chunks.count() == 1


def test_chunks_of_one_document_give_the_same():
    aligner = align.Aligner()
    one, many = align.Chunk(), [align.Chunk() for _ in ODD]
    for chunk, (doc_id, text) in zip(many, ODD, strict=True):
        one.add(doc_id, text, aligner)
        chunk.add(doc_id, text, aligner)
    together = one.aligned(0, aligner).column("digests").to_pylist()[0]
    assert together == [c.aligned(0, aligner).column("digests").to_pylist()[0][0] for c in many]


def test_the_identity_map_holds_the_same_bytes():
    aligner = align.Aligner()
    known = [(a, b) for a, b in enumerate(aligner.identity.tolist()) if b >= 0]
    assert len(known) > 5000
    assert all(aligner.a.bytes[a] == aligner.b.bytes[b] for a, b in known)


def test_hard_cases(hard, nothing, brute):
    found = align.align(hard)[0]
    assert plain(found) == brute([(r.doc_id, r.text) for r in hard.collect()])[0]
    assert align.align(nothing)[0].collect() == []
