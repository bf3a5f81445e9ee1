"""Markdown of hand-worked pages."""

from __future__ import annotations

import pytest

from harvestry.sources.markdown import Writer

CASES = [
    ("<h2> A <b>b</b></h2><p>x<p> <div>y</div>", "## A **b**\n\nx\n\ny"),
    ("<a href='/p?q'>go</a> <a href='m.html' title='T'></a> <a href='https://www.o.org/x'><img></a><a name=z>n</a>", "[go](https://s.org/p?q) [T](https://s.org/d/m.html) [o.org](https://www.o.org/x)n"),
    ("<a href='#main'>Skip to content</a><a href='mailto:a@b'>m</a>", "[Skip to content](https://s.org/d/#main)[m](mailto:a@b)"),
    ("<ul><li>one<li>two<ol><li>in</li></ol></ul>", "*   one\n*   two\n    1. in"),
    ("<table><tr><th>N<th>V|w</tr><tr><td>1<td><i>2</i></tr></table>", "| N | V\\|w |\n| --- | --- |\n| 1 | _2_ |"),
    ("<pre>a *b\n c</pre><code>x_y</code> *z*", "```\na *b\n c\n```\n\n`x_y` \\*z\\*"),
    ("<blockquote><p>q</p><p>r</p></blockquote><hr>s<br>t", "> q\n>\n> r\n\n* * *\n\ns  \nt"),
    ("<script>no</script><svg><text>no</text></svg><iframe>no</iframe>ok", "ok"),
    ("<a href=x>two<p>lines</p></a>", "[two\\\n\\\nlines](https://s.org/d/x)"),
    ("", ""),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_markdown(html, want):
    assert Writer(html, "https://s.org/d/").markdown() == want
