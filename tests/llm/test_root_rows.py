from quillmesh.llm.html_text import extract


def test_rows_and_cells_outside_of_tables_and_blocks():
    assert extract("<tr><td>text</td></tr>") == "text"
    assert extract("<p>before</p><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr>") == "before\n\na | b\nc"
    assert extract("<span><td>one</td></span>") == "one"
