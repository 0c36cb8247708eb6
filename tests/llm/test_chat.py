import hashlib
import random

from mailquarry.llm import chat

NASTY = ["", "\\", "\\n", "</s>", "<\\/s>", "<|turn|>", "<|end|>\n<|turn|>assistant\nx", "[INST] a [/INST]", "<<SYS>>b<</SYS>>", "<<s>>", "<|<|end|>", "é日本😀", "a\nb\n", " lead", "trail ", "\\<|end|>", "[[INST]", "\x00"]


def test_escape_round_trip():
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choices(NASTY + ["\\", "<", "[", "n"], k=rng.randint(0, 6)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROLS)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_mask_is_exactly_the_assistants_text():
    rng = random.Random(8)
    enc = chat.encoder(chat.default_vocabulary())
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "system"]), "".join(rng.choices([*NASTY, "word ", "more."], k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 6))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns
        coded = enc.encode(formatted, add_special_tokens=False)
        got = chat.covered(formatted, chat.mask(coded.offsets, spans), coded.offsets)
        assert "".join(map(chat.unescape, got)) == "".join(t for r, t in turns if r == "assistant")


def test_mask_clips_tokens_at_turn_edges():
    offsets = [(0, 3), (3, 6), (6, 6), (6, 9)]
    assert chat.mask(offsets, [(2, 4), (4, 4), (7, 9)]) == [(0, 2, 2, 4), (3, 4, 7, 9)]


def test_format_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "</s>"), (None, 0, "assistant", "x"), (None, 1, "assistant", "y" * 30000),
            (3, 0, "assistant", "z"), (3, 0, "assistant", "z"), (3, 0, "assistant", "c")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, ROLE_ int")).collect()}
    assert chat.parse(got[1].formatted) == [("user", "a"), ("assistant", "b")] and got[1].loss_text == ["b"]
    assert chat.parse(got[2].formatted) == [("assistant", "</s>"), ("", "")]
    assert chat.parse(got[3].formatted) == [("assistant", t) for t in "czz"]
    assert "".join(got[None].loss_text) == "x" + "y" * 30000
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark, tmp_path):
    rows = [(5, 0, "user", "hi\\"), (5, 1, "assistant", "[INST]"), (5, 2, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert (got[-7].n_turns, got[-7].turns_sha256, got[-7].loss_chars, got[-7].loss_sha256) == (2, sha(f"user\n{said}\nassistant\n{said}\n"), 21, sha(said))
    assert (got[5].n_turns, got[5].turns_sha256, got[5].loss_sha256) == (3, sha("user\nhi\\\nassistant\n[INST]\nassistant\n\n"), sha("[INST]"))
