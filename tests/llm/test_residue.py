import pytest

from heddle.llm import residue

SCHEMA = "doc_id bigint, url string, title string, source string, text string, part string, host string"
CASES = [
    "For Alda, {{ item.fabric|upper }} is a soft choice.", "The new hat by <%= season %> is cut.", "Dear ${name}, thank you.", "In [[author_name]] the label shows.",
    "Met [INSERT name HERE] at noon.", "By [Your caption here] today.", "Dear <author_name>, hello.", "For Alda, XXXX is fine.", "Dear [object Object], hello.",
    "The vest by undefined is cut.", "Price on request: NaN, from us.", "Your text goes here.", "Placeholder copy for Alda, final wording pending.",
    "This is sample text for the block. Replace it with your own.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed tempor incididunt.",
    "404 Not Found", "500 Internal Server Error (request a-1)", "Service unavailable. Alda is down for maintenance.", "Traceback (most recent call last): KeyError in x",
    "Warning: Undefined array key \"a\" in /srv/x.php on line 13", "Access denied. Your request has been blocked.", "Please enable JavaScript to view this.",
    "> You need to enable JavaScript to run this app.", "Veuillez activer JavaScript pour afficher Alda.", "Bitte aktivieren Sie JavaScript, um Alda zu sehen.",
    "Per vedere Alda occorre attivare JavaScript.", "No se encuentra la página de Alda.", "Seite nicht gefunden: Alda wurde verschoben.",
    "By #{designer} today.", "Dear {brand.title}, hello.", "Met <season> at noon.", "Met __author_name__ at noon.", "From %item.fabric% with love.", "The vest (price to come) is cut.",
    "The vest by TK TK is cut.", "For Alda, undefined is a soft choice.", "Test test test, Alda, please ignore.", "Testing, testing.",
    "Real prose stands here. More of it.\nSorry, the page about Alda that you are looking for does not exist.\nAnd prose again.", "  Your   text  goes here.  ", "YOUR TEXT GOES HERE!",
]
DECOYS = [
    "Alda teaches JavaScript to cutters, and says a browser is only a loom.", 'A T-shirt reads "lorem ipsum" across the chest.', "The show was called Error 404, and every coat had a missing page sign.",
    "The word undefined hangs over the door.", "[The label] had to close, she wrote, and nobody [in the trade] was surprised.", "Access to the hem was denied to visitors.",
    "Alda built a template for the coat and left the name blank on purpose.", "Nothing was found at the mill, the page of the diary is torn out.", "Coffee, silk samples, no collection.",
    "There is more to come (more to come), she said (and more to come).", "He wore <b>silk</b> under a <span>coat</span>.", "They test testers at the mill.", "Liulquihol at 40% of what it was, 50% less.", "The set {1, 2} of __ lines, and _this_ one.",
    "50% of it was silk, 30% wool.", "Reproduction in whole or in part is forbidden.", "", "   \n ", None, "x" * 100_000, "a 404 coats b",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert residue.has_residue(text)
    assert residue.has_residue(text, None, residue.cue_automaton())


@pytest.mark.parametrize("text", DECOYS)
def test_decoys(text):
    assert not residue.has_residue(text) and not residue.has_residue(text, None, residue.cue_automaton())


@pytest.mark.parametrize(
    ("title", "case"),
    [("Page not found", True), ("%TITLE%", True), ("404 - Alda", True), ("Error 500", True), ("Title TK: Alda", True), ("<title>", True), ("Sample post 530", True), ("undefined", True), ("Error 404: the lost coat", False), ("Undefined: Alda and the seam", False), ("Just a moment with Alda", False), ("Access denied, says Alda, and shuts", False), (None, False), ("", False), ("Alda [part two]", False)],
)
def test_titles(title, case):
    assert residue.has_residue("Plain text.", title) is case


def test_documents(spark):
    dup = "This item can't be shown.\nThe server took long."
    rows = [(k, f"https://h{k % 3}.example/red-coat-of-alda", "Red coat of Alda", "s", dup, "", "") for k in range(6)]
    rows += [(10, None, None, None, CASES[0], "", ""), (10, None, None, None, CASES[0], "", ""), (11, None, "Page not found", "s", None, "", ""), (12, None, None, None, None, "", ""), (13, None, "t", "s", DECOYS[0], "", ""), (None, None, None, None, CASES[0], "", "")]
    got = sorted(map(tuple, residue.residue(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [*[(k, "duplicate") for k in range(6)], (10, "detector"), (11, "detector")]


def test_responses_of_one_host(spark):
    """A host's own message in words that no detector knows, of any length and under many addresses, is found by its copies."""
    message = "\n".join([f"Nothing stands at place {{n}} since the page store was emptied by Alda in {y}." for y in range(1990, 2000)])
    rows = [(k, f"https://h.example/why-{a}-chose-{b}", f"Why {a} chose {b}", "s", message.replace("{n}", str(k)), "", "") for k, (a, b) in enumerate([("drisel", "poplin"), ("marquil", "velvet"), ("tolven", "gauze"), ("birrad", "denim"), ("sunter", "suede")])]
    rows += [(100 + k, f"https://h.example/the-same-{k % 2}", "The same", "s", message.replace("Nothing", "Not anything").replace("store", "shelf"), "", "") for k in range(2)]  # too few
    rows += [(200 + k, f"https://h.example/x{k}", f"The page store of Alda {k}", "s", message.replace("{n}", "place page store"), "", "") for k in range(5)]  # names what it is about
    got = {r.doc_id: r.reason for r in residue.residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: "duplicate" for k in range(5)}
    empty = spark.createDataFrame([], SCHEMA)
    assert residue.residue(empty).count() == 0
