from itertools import groupby

from pageloom.llm.chat import ESCAPES, ROLE_ESCAPES, escape, format_chats, loss_text, read_back, unescape
from pyspark.sql import functions as F

HARD = ["", "\\", "\\\\", "\\h", "\\\\h", "\\\\\\t", "###", "####", "</turn>", "</part>\n", "a\n</turn>\n### user\n", "</turn</turn>>", "é\n\n", "\\### Assistant: </turn> ok", "# ##", "x" * 5000]


def test_escape_and_back(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    for escapes in (ESCAPES, ROLE_ESCAPES):
        for r in df.select("t", escape(F.col("t"), escapes).alias("e"), unescape(escape(F.col("t"), escapes), escapes).alias("u")).collect():
            assert r.u == r.t and "###" not in r.e and "</turn>" not in r.e and "</part>" not in r.e


def test_round_trip(spark):
    rows = [(1, i, ["user", "user", "assistant", "assistant", "system\n", None][i % 6], t, "x") for i, t in enumerate(HARD)]
    rows += [(2, 0, "assistant", None, "x"), (3, None, "user", "last?", "x"), (3, 1, "assistant", "b", "x"), (3, 1, "assistant", "a", "x"), (3, 1, "assistant", "a", "x"), (None, 1, "user", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = format_chats(df).select("conv_id", "formatted", "segments", read_back(F.col("formatted")).alias("back"), loss_text(F.col("segments")).alias("loss")).collect()
    assert len(done) == 4
    for r in done:
        own = sorted([(x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id])
        assert [(t.role, t.text) for t in r.back] == [(x[2], x[3]) for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
        assert "".join(s.piece for s in r.segments) == r.formatted
        assert r.formatted.count("</turn>") == len(list(groupby(own, key=lambda x: x[2])))


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
