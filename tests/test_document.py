"""The whole layout pipeline on one small document whose Markdown is known."""

from foliant.operators import document

SCHEMA = "doc_id long, page_no long, block_no long, line_no long, text string, x0 double, y0 double, x1 double, y1 double, font string, size double"


def page(doc: int, p: int, lines: list[tuple]) -> list[tuple]:
    """Lines (block, text, y, font) of a page; block and line numbers go on over pages."""
    return [(doc, p, 100 * p + b, 100 * p + i, text, 72.0, float(y), 300.0, y + 10.0, font, 10.0) for i, (b, text, y, font) in enumerate(lines)]


def test_markdown_of_a_known_document(spark):
    rows = page(1, 0, [
        (0, "Annual Report 1", 20, "Serif"), (1, "Opening", 60, "Serif-Bold"), (2, "The first sentence runs", 100, "Serif"), (2, "over two lines.", 114, "Serif"),
        (3, "cell text", 200, "Serif"), (4, "In the picture", 300, "Serif"), (5, "x = y", 400, "MathSym"), (6, "   ", 420, "Serif"), (7, "Page 1", 700, "Serif"),
    ]) + page(1, 1, [(0, "Annual Report 2", 20, "Serif"), (1, "Closing words.", 60, "Serif"), (2, "Page 2", 700, "Serif")])
    rows += page(2, 0, [(0, "a b", 60, "MathSym")])  # nothing stays: no row
    lay = spark.createDataFrame(rows, SCHEMA)
    box = "doc_id long, page_no long, b_x0 double, b_y0 double, b_x1 double, b_y1 double"
    tables = spark.createDataFrame([(1, 0, 70.0, 195.0, 310.0, 215.0)], box)
    figures = spark.createDataFrame([(1, 0, 70.0, 295.0, 310.0, 315.0)], box)
    got = {r.doc_id: r.text for r in document.markdown(lay, tables, figures).select("doc_id", "text").collect()}
    assert got == {1: "**Opening**\n\nThe first sentence runs over two lines.\n\nClosing words."}
    with_boxes = document.markdown(lay).where("doc_id = 1").first().text
    assert with_boxes.split("\n\n")[2:4] == ["cell text", "In the picture"]
    assert document.markdown(lay.where("false")).collect() == []
