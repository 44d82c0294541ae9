"""Clusters of mentions, how a cluster gives a tag, and the same with a stream's state."""

import pytest
from pyspark.sql import functions as F

from quantspark.operators.coreference import clusters, mentions, resolved, stand_in
from quantspark.streaming import context as stream_context


def shown(previous, sentence):
    whole = f"{previous} {sentence}"
    return [[whole[a:b] for a, b in c] for c in clusters(previous, sentence)]


def test_mentions():
    text = "The old tower of Rome holds it, and its 5 bells ring."
    kinds = {text[slice(*m.span)]: m.kind for m in mentions(text)}
    assert kinds["The old tower"] == "definite" and kinds["Rome"] == "name" and kinds["it"] == "pronoun"


def test_clusters_that_share_a_mention_are_one():
    found = shown("The Iron Tower is old.", "It is tall, and the tower is red.")
    assert found == [["The Iron Tower", "It", "the tower"]]
    assert shown("The Iron Tower is old.", "A bridge is tall.") == []


def test_names_join_longer_names():
    assert shown("Queen Anna was old.", "Then Maria was ill.") == []
    assert shown("Queen Anna Maria was old.", "The king was with Anna.") == [["Queen Anna Maria", "Anna"]]


#: (previous, sentence, wanted, back-end) and what is found; each rule with a row that it accepts and one that it rejects.
CASES = [
    # A cluster with a mention in the sentence, and one without.
    ("The Iron Tower is old.", "It is 5 m high.", {"entity": ["Iron Tower"]}, "head_noun", {"entity": "It"}),
    ("The Iron Tower is old.", "Bridges are 5 m high.", {"entity": ["Iron Tower"]}, "head_noun", {}),
    # Names that the head has, and others.
    ("The Iron Tower is old.", "It is 5 m high.", {"entity": ["Stone Bridge"]}, "head_noun", {}),
    # No sentence before.
    (None, "It is 5 m high.", {"entity": ["Iron Tower"]}, "head_noun", {}),
    # The head is cut before ", which".
    ("The debt is high.", "It is 5 m.", {"entity": ["debt"]}, "head_noun", {"entity": "It"}),
    ("The debt, which the Iron Tower dwarfs, is high.", "It is 5 m.", {"entity": ["Iron Tower"]}, "head_noun", {}),
    # Several tags from one cluster; only those asked for.
    ("The height of the Iron Tower is known.", "It is 5 m.", {"entity": ["Iron Tower"], "property": ["height"]}, "head_noun", {"entity": "It", "property": "It"}),
    ("The height of the Iron Tower is known.", "It is 5 m.", {"property": ["width"]}, "head_noun", {}),
    # The first mention of a cluster that has several.
    ("The Iron Tower is old.", "It is 5 m high, and the tower is red.", {"entity": ["Iron Tower"]}, "head_noun", {"entity": "It"}),
    # Word by word: names of one word are found, those of two aren't.
    ("The Iron Tower is old.", "In spring the tower is 5 m high.", {"entity": ["tower"]}, "single_words", {"entity": "the"}),
    ("The Iron Tower is old.", "In spring the tower is 5 m high.", {"entity": ["Iron Tower"]}, "single_words", {}),
    # Pronouns alone.
    ("The Iron Tower is old.", "In spring the tower is 5 m high.", {"entity": ["Iron Tower"]}, "pronoun", {}),
    ("The Iron Tower is old.", "It is 5 m high.", {"entity": ["Iron Tower"]}, "pronoun", {"entity": "It"}),
    # A pronoun that doesn't begin the sentence stands for something else.
    ("The Iron Tower is old.", "Rain hits it.", {"entity": ["Iron Tower"]}, "head_noun", {}),
    ("The Iron Tower is old.", "It is 5 m high.", {"entity": ["Iron Tower"]}, "none", {}),
]


@pytest.mark.parametrize("previous,sentence,wanted,back_end,want", CASES)
def test_tags_of_clusters(previous, sentence, wanted, back_end, want):
    found = resolved(previous, sentence, wanted, back_end)
    assert {t: sentence[a:b] for t, (a, b) in found.items()} == want
    if set(wanted) == {"entity"}:
        assert stand_in(previous, sentence, wanted["entity"], back_end) == found.get("entity")


@pytest.fixture
def turns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 12")
    opening = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("The Iron Tower is old. "), F.substring("text", 1, 40))).otherwise(F.concat(F.lit("It is tall. "), F.substring("text", 1, 40)))
    return rows.select(F.col("conv_id").alias("page_id"), F.col("turn").cast("long").alias("sent_idx"), opening.alias("sentence")).cache()


def test_stream_gives_the_batch_answer(spark, turns, tmp_path):
    by_page: dict[int, list] = {}
    for r in sorted(turns.collect(), key=lambda r: (r.page_id, r.sent_idx)):
        by_page.setdefault(r.page_id, []).append(r)
    want = sorted((p, r.sent_idx, rows[k - 1].sentence if k else None, [(m["start"], m["end"]) for m in stream_context._mentions(rows[k - 1].sentence if k else None, r.sentence, "head_noun")]) for p, rows in by_page.items() for k, r in enumerate(rows))
    assert any(m for *_, m in want)
    most = max(r.sent_idx for rows in by_page.values() for r in rows) + 1
    for size in (3, most):
        source, out = f"{tmp_path}/in{size}", f"{tmp_path}/out{size}"
        for k in range(0, most, size):
            turns.where(F.col("sent_idx").between(k, k + size - 1)).coalesce(1).write.mode("append").json(source)
        stream = stream_context.with_context(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).json(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.page_id, r.sent_idx, r.previous, [(m.start, m.end) for m in r.mentions]) for r in spark.read.parquet(out).collect())
        assert got == want


def test_idle_pages_end():
    import pandas as pd

    class State:
        exists, hasTimedOut, removed, waits = True, False, False, None
        get = (3, "The Iron Tower is old.")

        def update(self, value):
            self.get = value

        def setTimeoutDuration(self, ms):
            self.waits = ms

        def remove(self):
            self.removed = True

    state, step = State(), stream_context._step("head_noun", 500)
    rows = list(step((1,), iter([pd.DataFrame({"sent_idx": [4], "sentence": ["It is tall."]})]), state))[0]
    assert rows["previous"][0] == "The Iron Tower is old." and rows["mentions"][0] == [{"start": 0, "end": 2}]
    assert state.waits == 500 and state.get == (4, "It is tall.") and not state.removed
    state.hasTimedOut = True
    assert list(step((1,), iter([]), state)) == [] and state.removed
