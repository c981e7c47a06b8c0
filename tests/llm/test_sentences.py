import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairngraph.llm.sentences import sentence_units, sentences


def units(text):
    return [text[a:b] for a, b in sentence_units(text)]


CASES = [
    ["Dr. Vorlund saw e.g. Fig. 3 and No. 7 at 5 p.m. today.", "It cost 3.50 in v1.2.3."],
    ["The plan by J. Drelling moves x.y.z into a.b.", "See cf. Appendix D of it."],
    ['The log said "No hash found. Run it again." and the job stopped.', "Then it ran."],
    ["“Stop!” wrote Kaspurne, but it went on.", "Why?!", "the rest is left to open_key()."],
    ["Reviewer Quistrava wrote, “The token is stale.”", "This is all."],
    ["(The edge is rebuilt on every call.)", "The rest (see below. It is short.) stays."],
    ["We waited ... and then it came back.", "It was slow… the second took 2.9 s.", "Then…", "Nothing came."],
    ["Step 2. of the old list is void.", "The flags -x, -y etc. are read.", "It has parts etc.", "We go on."],
    ["Das gilt ab dem 3. Mai für z. B. alle.", "Der Hinweis lautet: „Kein Ziel.“", "Siehe Nr. 5 auf S. 336.", "Ende am 2. Tag."],
    ["Le journal indique « Rien. Relancez. » puis s’arrête.", "M. Tessamark a relu la page 5.", "Ne pas fusionner !", "Voir p. ex. ScopePlan."],
    ["¡No lo borres!", "La Sra. Quistrava preguntó: «¿Sigue en uso?»", "Es todo."],
    ["Это касается вызовов и т. д.", "По словам г. Yarrowick, граф пуст.", "Всего ок. 5 рёбер, т. е. мало.", "Занимает 0,3 с.", "Всё."],
    ["Γιατί καλείται δύο φορές η f;", "Βλ. π.χ. τον πίνακα 8.", "Γράφει «Τίποτα. Ξανά.» και σταματά."],
    ["डॉ. Drelling ने देखा।", "क्र. सं. 5 खाली है।", "यह है.", "वह भी है।"],
    ["قال د. Kaspurne إن الرسم فارغ.", "لماذا؟", "كتب «لا شيء. أعد.» ثم توقف."],
    ["왜 두 번 호출합니까?", "tests/a.py의 검사는 3.5초가 걸립니다.", '로그에 "없습니다. 다시."라고 적혀 있었습니다.'],
]


@pytest.mark.parametrize("want", CASES, ids=lambda c: c[0][:20])
def test_prose(want):
    assert units(" ".join(want)) == want


def test_scripts_without_spaces():
    assert units("他问“还在用吗？”的时候没有人。真的吗？！日志写着「没有。请重试。」的提示，然后停止。第二遍……更长。") == ["他问“还在用吗？”的时候没有人。", "真的吗？！", "日志写着「没有。请重试。」的提示，然后停止。", "第二遍……更长。"]
    assert units("本当ですか\n「まだ使っていますか？」と聞かれました\n残りはa.bにあります") == ["本当ですか", "「まだ使っていますか？」と聞かれました", "残りはa.bにあります"]
    assert units("คลาส A.b อยู่ในแฟ้ม src/x.py เหมือนเดิม อย่าเพิ่งลบส่วนนี้ คะแนนลดลง") == ["คลาส A.b อยู่ในแฟ้ม src/x.py เหมือนเดิม", "อย่าเพิ่งลบส่วนนี้", "คะแนนลดลง"]


def test_layout():
    text = "# 1. Scope\nA line that\nwraps. Next\n\n1) fix a\n2) B is. C is\n   wrapped\n```py\n# Done. Next.\n```\n* x: y\n* z!\n\nEnd: it is; no end"
    assert units(text) == ["# 1. Scope", "A line that\nwraps.", "Next", "1) fix a", "2) B is.", "C is\n   wrapped", "```py\n# Done. Next.\n```", "* x: y", "* z!", "End: it is; no end"]


@pytest.mark.parametrize(
    "want",
    [
        ["1. First item", "   1. Inner one", "   2. Inner two", "2. Second item", "3. Third item"],
        ["1. First item", "   - sub bullet", "2. Second item"],
        ["1. alpha", "1. beta", "1. gamma"],
        ["- a", "  1. b", "     * c", "  2. d\n     goes on", "- e"],
        ["1. a", "\n   1. b", "\n   2. c", "2. d"],
        ["9. a", " 10. b", "11. c is for\n3. of d"],
    ],
)
def test_nested_lists(want):
    assert units("\n".join(want)) == [w.strip() for w in want]


@pytest.mark.parametrize("text", ["x=1;" * 400_000, "(a. B" * 100_000, "(" * 300_000 + "]" * 300_000, '"' * 500_000, "«" * 300_000 + ". A" * 300_000, "α;" * 300_000, "1. a\n" * 100_000])
def test_time_grows_with_length_alone(text):
    began = time.process_time()
    assert sentence_units(text)[-1][1] == len(text.rstrip())
    assert time.process_time() - began < 8


def test_a_wrapped_number_begins_no_item():
    assert units("We saw Step\n2. of the list and\n12 more.") == ["We saw Step\n2. of the list and\n12 more."]


def test_an_abbreviation_may_be_wrapped():
    assert units("Das liegt z.\r\nB. in a.b. Siehe S.\n5. Es gilt d.\u00a0h. immer.") == ["Das liegt z.\r\nB. in a.b.", "Siehe S.\n5.", "Es gilt d.\u00a0h. immer."]


def test_unclosed_marks_hold_nothing_back():
    assert units('"One is. Two is. (Three is. Four') == ['"One is.', "Two is.", "(Three is.", "Four"]


def test_line_ends_and_code():
    assert units("One.\r\n\r\nTwo `a. B` is.\rThree") == ["One.", "Two `a. B` is.", "Three"]


@pytest.mark.parametrize("text", [None, "", " \n\t "])
def test_nothing(text):
    assert sentence_units(text) == []


@given(st.text(alphabet="aB .!?…“”\"'()«»\n\r#-*1`。」ก ;α", max_size=60))
def test_units_cover_all_and_do_not_overlap(text):
    at = 0
    for a, b in sentence_units(text):
        assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_a_very_long_text():
    text = "Word after word. " * 60_000
    assert len(sentence_units(text)) == 60_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, ""), (4, "A b. C d."), (None, "x")], "doc_id long, text string").selectExpr("*", "1 as start_char", "'x' as i")
    got = sentences(df)
    assert [x.dataType.simpleString() for x in got.schema] == ["bigint", "int", "int"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, 4), (1, 5, 9), (4, 0, 4), (4, 5, 9)]
    assert sentences(df.where("false")).count() == 0
