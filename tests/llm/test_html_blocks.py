"""Elements whose content isn't markup, and elements left open: nothing after them is lost."""

import pytest

from sonoframe.llm import page_templates
from sonoframe.llm.html_blocks import blocks


@pytest.mark.parametrize("bare", [b for b in page_templates.BARE] + ["<script>a</scripty>b<c</script>", "<SCRIPT>a<b</script\n>", "<template><template></template>", "<math><mrow>"])
def test_nothing_after_it_is_lost(bare):
    assert [b.text for b in blocks(f"<p>One</p>{bare}<p>Two</p><div>Three</div><script>1</script><p>Four")] == ["One", "Two", "Three", "Four"]


def test_foreign_text_flows_with_its_block():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>, so <svg><title>A</title><text>b</text></svg> it <object><b>holds</b></object>.</p><p>End"
    assert [b.text for b in blocks(page)] == ["Let x = 1 2, so A b it holds.", "End"]
    assert [[names[0] for names in b.path] for b in blocks(page)] == [["p"], ["p"]]


def test_code_left_open_reaches_to_the_end():
    assert [b.text for b in blocks("<p>One</p><script>a<b; <p>Two</p>")] == ["One"]
    assert [b.text for b in blocks("<p>One</p><style>a<b; <p>Two</p>")] == ["One"]


def test_pages_come_out_as_made():
    made = page_templates.pages(200, 5)
    assert sum([b.text for b in blocks(page)] == [text for text, _ in truth] for page, truth in made) >= 190
