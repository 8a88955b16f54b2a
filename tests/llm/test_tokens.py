import math

from recollect.llm import tokens


def brute(word, scores):
    """Least tokens among the best segmentations of a marked word, by recursion."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        found = []
        for begin in range(end):
            piece = word[begin:end]
            if piece in scores:
                found.append((best[begin][0] + scores[piece], -best[begin][1] - 1))
            elif end - begin == 1:
                n = len(piece.encode())
                found.append((best[begin][0] + tokens.BYTE * n, -best[begin][1] - n))
        score, n = max(found)
        best[end] = (score, -n)
    return best[len(word)][1]


def test_counts_against_each_word_alone():
    scores = tokens.pieces()
    trie = tokens.Trie(scores)
    for w in ("the", "then", "thenceforth", "désolé", "😀", "zzzzzz", "the", "a" * 90, "…"):
        assert trie[w] == brute(tokens.START + w, scores)


def test_counts_of_a_unigram_tokenizer():
    """The same pieces and scores in a public library's unigram model give the same counts."""
    from tokenizers import Tokenizer, models

    scores = tokens.pieces()
    vocabulary = [("<unk>", -1e4), *scores.items()]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    trie = tokens.Trie(scores)
    text = "the thence token tokenization internationally désolé chat étaient walking talking unbelievable antidisestablishmentarianism " + "ab" * 60
    for w in text.split():
        assert trie[w] == len(tokenizer.encode(tokens.START + w, add_special_tokens=False).ids), w


def test_prefixes_are_computed_once_and_memory_is_bounded():
    trie = tokens.Trie(tokens.pieces(), nodes=50)
    trie["walk"]
    before = trie.computed
    trie["walking"]
    assert trie.computed == before + 3
    free = tokens.Trie(tokens.pieces())
    words = [f"word{i}x{i % 7}" for i in range(400)]
    assert [trie[w] for w in words] == [free[w] for w in words]
    assert len(trie) < 100


def test_scores_are_a_distribution():
    assert math.isclose(sum(map(math.exp, tokens.pieces().values())), 1.0, rel_tol=1e-6)


def test_hard_cases(hard, nothing):
    rows = tokens.count_tokens(hard).collect()
    assert len(rows) == hard.count()
    by = {r.doc_id: r for r in rows}
    assert [(by[i].n_pretokens, by[i].n_tokens) for i in (3, 4, 5)] == [(0, 0)] * 3
    trie = tokens.Trie(tokens.pieces())
    for r in hard.collect():
        assert by[r.doc_id].n_tokens == sum(trie[w] for w in (r.text or "").split())
    assert tokens.count_tokens(nothing).collect() == []
