import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.operators.index import Index, build_index
from heddle.plans import parser, search
from heddle.plans.parser import And, Not, Or, QueryError, Term, parse

DOCS = [(1, "red silk coat", "T1"), (2, "red wool coats", ""), (3, None, None), (4, "", "T4"), (5, "silk and wool #red", "T5"), (6, "coat", "T6")]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(DOCS, "doc_id bigint, text string, title string"))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("!shoes && fashion || design", Or(And(Not(Term("shoes")), Term("fashion")), Term("design"))),
        ("fashion !shoes", Term("fashion")),
        ("fashion (a || b)", Term("fashion")),
        ("(a || b) c", And(Or(Term("a"), Term("b")), Term("c"))),
        ("Fashion AND design", And(And(Term("fashion"), Term("and")), Term("design"))),
        ("state-of-the-art", Term("state")),
        ("a & b", And(And(Term("a"), Term("&")), Term("b"))),
        ("a|b", Term("a|b")),
        ("a) b", Term("a")),
        ("!!a", Term("a")),
    ],
)
def test_compatible_grammar(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize("query", ["(a", "", "  ", "a &&", "!", "()", "|| a", "(" * 5])
def test_unreadable_queries(query):
    with pytest.raises(QueryError):
        parse(query)


def test_strict_grammar():
    assert parse("a AND NOT (b OR c)", strict=True) == And(Term("a"), Not(Or(Term("b"), Term("c"))))
    with pytest.raises(QueryError):
        parse("a ) b", strict=True)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from("abc").map(Term), lambda x: st.one_of(x.map(Not), st.tuples(x, x).map(lambda p: And(*p)), st.tuples(x, x).map(lambda p: Or(*p))), max_leaves=8), st.sets(st.sampled_from("abc")))
def test_written_tree_reads_the_same(tree, true):
    def write(n):
        if isinstance(n, Term):
            return n.value
        if isinstance(n, Not):
            return f"!({write(n.inner)})"
        return f"({write(n.left)}) {'&&' if isinstance(n, And) else '||'} ({write(n.right)})"

    value = lambda n: parser.evaluate(n, lambda t: t in true)
    assert value(parse(write(tree))) == value(tree)


@pytest.mark.parametrize(
    ("query", "wanted"),
    [("coat", [0, 1, 5]), ("coat silk", [0]), ("red || wool", [0, 1, 4]), ("!coat", [2, 3, 4]), ("!nothinglikeit", [0, 1, 2, 3, 4, 5]), ("nothinglikeit && coat", []), ("!coat && silk", [4]), ("(coat", []), ("", []), ("coats", [])],
)
def test_search(index, query, wanted):
    assert ids(search.search(index, query)) == wanted


def test_stemmed_query_and_stats(index):
    assert ids(search.search(index, "coats", stem_query=True)) == [0, 1, 5]
    assert search.search_stats(index, "coat && (silk)") == search.SearchStats("coat && (silk)", 1, 6)


def test_batch_equals_single_queries(index):
    rng = random.Random(5)
    words = ["coat", "silk", "wool", "red", "none"]
    queries = [" ".join(rng.choice(["", "!"]) + rng.choice(words) + rng.choice([" &&", " ||"]) for _ in range(rng.randrange(1, 4))) + " " + rng.choice(words) for _ in range(12)]
    queries += ["coat", "coat", "a &&", " || ".join(f"w{k}" for k in range(12)) + " || silk"]
    got = search.batch_search(index, queries).collect()
    for k, q in enumerate(queries):
        assert sorted(r.doc_id for r in got if r.query_no == k) == ids(search.search(index, q)), q


def test_pages(index):
    found = search.search(index, "!nothinglikeit")
    page = search.format_results(found, index, 1, 3).orderBy("rank").collect()
    assert [(r.rank, r.doc_id, r.title, r.relevance) for r in page] == [(2, 1, "Untitled Document", 1 / 2), (3, 2, "Untitled Document", 1 / 3), (4, 3, "T4", 1 / 4)]
    assert search.format_results(found, index, 6, 3).count() == 0


def test_index_round_trip(spark, index, tmp_path):
    index.save(str(tmp_path / "ix"))
    back = Index.load(spark, str(tmp_path / "ix"))
    assert sorted(back.forward.collect()) == sorted(index.forward.collect())
    assert sorted(back.postings.collect()) == sorted(index.postings.collect())
    assert [r.doc_id for r in back.find_term("coat").collect()] == [0, 1, 5]
    assert back.find_term("none").count() == 0
    assert back.document_info(1).first().doc_length == 3
    with pytest.raises(IndexError):
        back.document_info(99)


def test_empty_corpus(spark):
    index = build_index(spark.createDataFrame([], "doc_id bigint, text string, title string"))
    assert index.statistics().first().total_documents == 0
    assert ids(search.search(index, "!a")) == []


def test_equal_documents_have_numbers_of_their_own(spark):
    rows = [(1, "u", "red coat coat"), (1, "u", "red coat coat"), (None, "n", "silk"), (1, "u", "blue"), (2, None, None)]
    index = build_index(spark.createDataFrame(rows, "doc_id bigint, url string, content string"))
    assert sorted(r.doc_id for r in index.forward.collect()) == [0, 1, 2, 3, 4]
    assert sorted((r.doc_id, r.tf) for r in index.postings.where("term = 'coat'").collect()) in ([(1, 2), (2, 2)], [(2, 2), (3, 2)], [(1, 2), (3, 2)])
    assert [r.doc_id for r in index.find_term("silk").collect()] == [0]
