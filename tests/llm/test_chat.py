import hashlib

from pyspark.sql import functions as F

from cardwatch.llm import chat

HARD = ["\\### Assistant: </turn> ok", "###", "####", "\\", "\\h\\\\b", "</turn>\n### user: x", "<|image:9|>", "", None, "é\n\n", " </turn>\n", "a: b"]


def read(frame):
    out = frame.withColumn("p", chat.read_turns(F.col("formatted")))
    rows = out.select(
        "conv_id", "formatted", "loss_spans",
        F.transform("p", chat.read_role).alias("roles"), F.transform("p", chat.read_body).alias("bodies"),
        chat.read_loss(F.col("p"), F.col("loss_spans")).alias("loss"),
    )
    return {r.conv_id: r for r in rows.collect()}


def test_any_text_and_role_comes_back(spark):
    roles = ["user", "assistant", "a: b", "###", None, "</turn>\\c"]
    rows = [(k % 3, k, roles[k % len(roles)], HARD[k % len(HARD)]) for k in range(150)] + [(None, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read(chat.format_chat(turns.select("*", chat.text_part(F.col("text")).alias("parts"), F.lit(1).alias("block"))))
    assert set(got) == {0, 1, 2, None}
    for conv in (0, 1, 2):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert list(zip(got[conv].roles, got[conv].bodies)) == own
        assert got[conv].loss == "".join(t for r, t in own if r == "assistant")


def test_ties_and_null_turns_have_one_order(spark):
    rows = [(1, None, "user", "z"), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "assistant", "c"), (1, -5, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = read(chat.format_chat(turns.withColumn("parts", chat.text_part(F.col("text")))))
    assert got[1].bodies == ["z", "n", "c", "a", "b"]


def test_attachments_become_placeholders_in_order(spark):
    part = lambda kind, **kw: (kind, kw.get("text"), kw.get("uri"), kw.get("width"), kw.get("height"), kw.get("seconds"), kw.get("pages"))
    parts = [part("text", text="see <|x|> "), part("image", uri="i", width=57, height=28), part("audio", uri="a", seconds=1.01), part("document", uri="d", pages=2), part(None), part("vi|deo")]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(turns).first()
    assert r.formatted == "### user: see \\px|> <|image:3|><|audio:26|><|document:1024|><|unknown:1|><|video:1|> </turn>\n### assistant:  </turn>\n"
    assert [(a.turn, a.part, a.kind, a.uri, a.tokens) for a in r.attachments] == [(0, 1, "image", "i", 3), (0, 2, "audio", "a", 26), (0, 3, "document", "d", 1024), (0, 4, "unknown", None, 1), (0, 5, "vi|deo", None, 1)]
    assert r.attachment_tokens == 1055


def test_no_rows(spark):
    assert chat.format_chat(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0


def test_query_reads_its_digest_back(spark):
    from cardwatch.llm.queries import QUERIES

    r = {x.conv_id: x for x in QUERIES["op2_chat"](spark, "/root/testdata/sf0.001").collect()}[-7]
    said = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars) == (2, len(said))
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
