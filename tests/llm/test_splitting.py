from hypothesis import given, settings
from hypothesis import strategies as st

from cordonlake.llm.splitting import split_items, split_spans, structure

SCHEMA = "doc_id string, text string, blocks array<struct<len int, page int, section string>>, page string, piece int"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#-1;é", max_size=300), st.integers(5, 60))
def test_spans_cover_the_text_and_fit(text, limit):
    spans = split_spans(text, limit)
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(b - a <= limit for a, b in spans)


def test_cuts_are_natural():
    text = "# One\nFirst sentence here. Second one.\n# Two\n- item a\n- item b\n"
    cut = [text[a:b] for a, b in split_spans(text, 40)]
    assert cut[0] == "# One\nFirst sentence here. Second one.\n" and cut[1].startswith("# Two")
    assert split_spans("x" * 25, 10) == [(0, 10), (10, 20), (20, 25)]


def test_subtrees_are_merged_from_the_bottom_up():
    # the second part is divided; its short end goes with the part that follows
    text = "# A\naaaa.\n" + "# B\n" + "bbb bbb bbb. " * 4 + "end.\n" + "# C\ncc.\n"
    got = [text[a:b] for a, b in split_spans(text, 30)]
    assert "".join(got) == text and all(len(x) <= 30 for x in got)
    assert got[-1].startswith("bbb") and got[-1].endswith("end.\n# C\ncc.\n") or got[-1] == "end.\n# C\ncc.\n"
    tree = structure(text, 30)
    assert [text[c.start : c.end][:3] for c in tree.children] == ["# A", "# B", "# C"] and not tree.children[0].children and tree.children[1].children


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=120), st.integers(15, 60))
def test_few_pieces(words, limit):
    text = " ".join("w" * n for n in words)
    spans = split_spans(text, limit)
    # neighbours never fit together, so there are fewer than twice as many as the fewest that could do
    assert all(b2 - a1 > limit for (a1, _), (_, b2) in zip(spans, spans[1:]))


def doc(name, blocks, **extra):
    return (name, "\n".join(t for t, _, _ in blocks), [(len(t), p, s) for t, p, s in blocks], "x", 0)


def test_pieces_give_the_item_back(spark):
    big = [(f"Sentence {i} of the text goes on." * 3, 1 + i // 4, "A") for i in range(12)]
    blocks = [("head", 1, None), ("still", 1, None), *big, ("tail", 9, "B"), ("again", 9, "A")]
    rows = [doc("d", blocks), doc("e", []), ("n", None, [(3000, 1, "q")], "", 0), ("m", "text", None, "", 0)]
    got = split_items(spark.createDataFrame(rows, SCHEMA), 300, 50).where("doc_id = 'd'").orderBy("first_block", "piece").collect()
    text = rows[0][1]
    assert [r["first_block"] for r in got if r["piece"] == 0] == [0, 2, 14, 15]
    pieces = [r for r in got if r["first_block"] == 2]
    assert len(pieces) > 3 and all(len(r["text"]) <= 300 and r["text"] == text[r["start"] : r["end"]] for r in pieces)
    over = [a["end"] - b["start"] for a, b in zip(pieces, pieces[1:])]
    assert all(30 <= n <= 50 for n in over) and all(text[r["start"] - 1].isspace() for r in pieces[1:])
    assert "".join([pieces[0]["text"]] + [r["text"][n:] for r, n in zip(pieces[1:], over)]) == "\n".join(t for t, _, _ in big)
    assert [r["page"] for r in pieces] == sorted(r["page"] for r in pieces) and {r["section"] for r in pieces} == {"A"}
    only = split_items(spark.createDataFrame(rows, SCHEMA), 300, 50, only_oversized=True, with_text=False).select("doc_id", "first_block").distinct().collect()
    assert {tuple(r) for r in only} == {("d", 2), ("n", 0)}


def test_empty(spark):
    assert split_items(spark.createDataFrame([], SCHEMA)).collect() == []
