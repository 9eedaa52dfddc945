"""Chat formatting: round trips, and digests against plain ones."""

import hashlib

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from docweave.llm import chat, queries
from tests.llm.conftest import PROSE, rows

PIECES = ["\\", "\\\\", "<", "[", "]", ">", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "a", " ", "\n", "é🙂", "/", "s>", "INST]", "SYS>>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), TEXT)


@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
@example([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])
@settings(max_examples=1500, deadline=None)
def test_round_trip(turns):
    text, loss = chat.write_turns(turns)
    assert [t[:2] for t in chat.parse(text)] == turns
    assert [chat.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


@given(TEXT)
def test_escape_is_reversible_and_plain_text_stays(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not list(chat._marks(escaped + "</s>"))[:-1]
    assert chat.write_turns([("user", PROSE)])[0] == f"[INST]{PROSE}[/INST]"


@pytest.mark.parametrize("text", ["x", "[INST]", "[INST]a", "[/INST]", "<s>a[/INST]", "[INST]a[/INST]b", "[INST]a\\[/INST]", "[ROLE]a[/ROLE]", "<s><s></s></s>", "\\[INST]a[/INST]"])
def test_other_texts_are_refused(text):
    with pytest.raises(chat.Broken):
        chat.parse(text)


def plain(table):
    out = {}
    order = lambda r: (r.conv_id is not None, r.conv_id, r.turn is not None, r.turn, r.role or "")
    for r in sorted(table, key=order):
        out.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    learned = {c: "".join(t for r, t in turns if r == "assistant") for c, turns in out.items()}
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(learned[c]), sha(learned[c])) for c, t in out.items()}


ROWS = [
    (1, 0, "system", "be <s>brief</s>"), (1, 1, "user", PROSE), (1, 2, "assistant", "ok \\"), (1, None, "user", "first"),
    (2, 0, "assistant", None), (2, 1, None, "\\[INST]"), (2, 1, None, "\\[INST]"), (2, 2, "tool[TEXT]", ""),
    (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (3, 5, "user", "x" * 3_000_000), (3, 6, "assistant", "é🙂</s>" * 1000), (4, 0, "user", "a"),
]


def test_files(spark, tmp_path):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    many = spark.range(5000).selectExpr("7L AS conv_id", "id DIV 2 AS turn", "IF(id % 2 = 0, 'assistant', 'user') AS role", "concat(id DIV 2, ' [INST] ') AS text")
    same = spark.range(3000).selectExpr("8L AS conv_id", "1L AS turn", "'assistant' AS role", "'again' AS text")
    whole = table.union(many).union(same).repartition(5)
    chat.write(whole, str(tmp_path / "a"))
    got = rows(chat.digest(spark, str(tmp_path / "a")))
    assert {g[0]: g[1:5] for g in got} == plain(whole.collect()) and len(got) == 7
    stored = chat.read(spark, str(tmp_path / "a"))
    assert stored.groupBy("conv_id").count().where("count > 1").count() >= 2  # long ones lie in several segments
    for r in stored.collect():
        assert [t[0] for t in chat.parse(r.formatted)].count("assistant") == len(r.loss) and r.n_turns <= chat.TURNS
    chat.write(whole.selectExpr("*", "1 AS part", "2 AS number", "3 AS hash", "4 AS salt", "5 AS loss"), str(tmp_path / "b"))
    assert rows(chat.digest(spark, str(tmp_path / "b"))) == got
    chat.write(whole.where("false"), str(tmp_path / "c"))
    assert chat.digest(spark, str(tmp_path / "c")).count() == 0


def test_query(spark):
    base = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in queries.QUERIES["op11_chat_format"](spark, base).collect()}
    want = plain(spark.read.parquet(f"{base}/conversations.parquet").collect())
    odd = got.pop(-1)
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    said = "</s>[INST] ok [/INST]"
    assert odd.n_turns == 2 and odd.loss_chars == len(said) and odd.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert all(r.formatted_chars > 0 for r in got.values())
