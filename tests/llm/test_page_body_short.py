import random

from heddle.llm import page_body

SCHEMA = "rec_id bigint, url string, title string, content string"
NAMES = ["alda", "brin", "corv", "dest", "elmo", "fara", "gwin", "hest"]


def page(k: int):
    """A page and its lines outside the main body: buttons in short sentences, in a block, alone on most pages, or body."""
    rng = random.Random(k)
    prose = lambda: " ".join(rng.choice(NAMES) + rng.choice(NAMES) + rng.choice(NAMES) for _ in range(12)) + "."
    lines = [(f"The coat {prose()[:-1]}", False), (prose(), False)]
    if k % 4 == 0:
        lines.append(("Enough.", False))  # the article's own, now and then before a notice
    if k % 8 == 0:
        lines.append(("Advertisement", True))
    lines.append((prose(), False))
    if k % 3:
        lines.append(("Read more...", True))  # on two of three pages, between unique lines
    lines.append((prose(), False))
    if k % 5 == 0:
        lines += [("Questions about an order or a fitting", True), ("Need help?", True)]  # a run on a fifth of the pages
    lines += [("Subscribe now!", True), ("Accept all.", True), ("", False)]
    text = "\n".join(x for x, _ in lines)
    return (k, f"https://shop.example/p/{k}", lines[0][0], text), {(k, n) for n, (x, out) in enumerate(lines, 1) if out}


def test_short_sentences_by_share_and_run(spark):
    made = [page(k) for k in range(80)]
    store = spark.createDataFrame([r for r, _ in made], SCHEMA)
    wanted = set().union(*(w for _, w in made))
    assert {(r.rec_id, r.line_no) for r in page_body.lines_outside_body(store).collect()} == wanted
