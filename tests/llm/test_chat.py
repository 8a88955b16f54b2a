import hashlib

from recollect.llm import chat

HOSTILE = ["", "plain", "<|turn|>user<|text|>x<|end|>", "\\", "<\\|end|>", "a\\<|", "<", "<|", "|>", "é😀\r\n <|endoftext|>", " lead and trail ", "</s>[INST] ok [/INST]", "<<||", "\\\\<|turn|>"]


def test_round_trip_of_hostile_texts():
    turns = [(r, t) for t in HOSTILE for r in ("user", "assistant", "<|end|>", "")]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b, _ in spans] == [t for _, t in turns]


def test_mask_is_the_assistants_text():
    turns = [(("user", "assistant")[i % 2], t) for i, t in enumerate(HOSTILE * 2)]
    formatted, spans = chat.render(turns)
    got = chat.encoder().encode(formatted, add_special_tokens=False)
    masked = chat.mask(got.offsets, spans)
    assert chat.under(formatted, masked) == "".join(t for r, t in turns if r == "assistant")
    brute = [(k, max(a, x), min(b, y)) for x, y, r in spans if r == "assistant" for k, (a, b) in enumerate(got.offsets) if max(a, x) < min(b, y)]
    assert masked == brute


def test_conversations(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.turn):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out.keys() == want.keys()
    for k, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (out[k].n_turns, out[k].turns_sha256, out[k].loss_chars, out[k].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))


def test_hard_cases(spark):
    rows = [(1, 2, "assistant", "later"), (1, None, "user", None), (1, 2, "assistant", "later"), (None, 1, None, "x"), (2, 1, "assistant", "long " * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as tag")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 10 and out[None].n_turns == 1 and out[2].loss_chars == 100000
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []
