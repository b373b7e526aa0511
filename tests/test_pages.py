"""Pages by examples of what their vendors put into them."""

import random

import pytest

from convolake.operators import pages
from convolake.operators import tree as X


def read(spark, platform, *html):
    rows = spark.createDataFrame([(f"c{k}", h) for k, h in enumerate(html)], "conversation_id string, html string")
    return pages.read_pages(rows, platform).orderBy("conversation_id", "pos").collect()


def turn(content, around="", role="assistant"):
    return f'<article data-testid="conversation-turn-2"><div data-message-author-role="{role}" data-message-id="m">{content}</div>{around}</article>'


def test_trees_hold_what_pages_hold():
    page = X.parse("<div id=a>x<p class='q r'>y<br>z</p></nope><ul><li>1<li>2</ul></div><b>open <i>both")
    assert [n.tag for n in X.nodes(page)] == ["div", "p", "br", "ul", "li", "li", "b", "i"] and X.text(page) == "x y z 1 2 open both"
    p = X.first(page, ("", "class", "~", "r"))
    assert X.closest(p, ("", "id", "=", "a")).tag == "div" and not X.within(p, ("p", "", "?", "")) and X.next_node(p).tag == "ul"
    X.replace(p, "**raw**  `")
    X.remove(p, X.first(page, ("b", "", "?", "")))
    assert X.markdown(page) == "x**raw**  `\n- 1\n- 2" and p.up is None
    deep = X.parse("<div>" * 20_000 + "in" + "</div>" * 20_000)
    assert X.text(deep) == "in" == X.markdown(deep) and len(list(X.nodes(deep))) == 20_000


def test_rendering_a_tree_is_rendering_the_page():
    deal, tags = random.Random(9), ["div", "p", "b", "li", "ul", "pre", "code", "table", "tr", "td", "a", "h2", "br"]
    for _ in range(300):
        html = "".join(deal.choice([f"<{t}>", f"</{t}>", "a b", " ", "\n", "&amp;"]) for t in deal.choices(tags, k=deal.randint(1, 40)))
        tree = X.parse(html)
        # a page that closes all that it opens, and nothing else, is rendered as the parser itself would
        closed = X.markdown(tree)
        again = pages._markup(tree).removeprefix("<>").removesuffix("</>").replace("</br>", "").replace("&", "&amp;")
        assert X.markdown(X.parse(again)) == closed


MATH = {
    '<span data-math-source="a+b"><span class="katex">drawn</span></span>': "$a+b$", '<span data-math-source="c" style="display: block">d</span>': "$$c$$", '<span data-math-source="c" data-math-display="false" style="display:block"></span>': "$c$",
    '<span class="katex-display"><span class="katex"><annotation encoding="application/x-tex"> x^2 </annotation>x2</span></span>': "$$x^2$$", '<span class="katex"><annotation encoding="application/x-tex">y</annotation>y</span>': "$y$", '<span class="katex">kept</span>': "kept",
    '<div data-math="E">E</div>': "$$E$$", '<span data-math="F">F</span>': "$F$", '<span data-math=" ">G</span>': "G", '<div data-testid="math-block-layout"><span class="sr-only">said</span><div class="control-panel">slider</div><span data-math-source="q">q</span></div>': "$q$\nsaid",
}
CODE = {
    '<pre><div class="font-sans"><div>C++</div><button>Copy</button></div><code>x</code></pre>': "```cpp\nx\n```", '<div data-markdown-copy="code-block"><div class="font-sans"><div class="truncate">Python</div></div><pre><code>y</code></pre></div>': "```python\ny\n```",
    '<div data-markdown-copy="code-block"><div class="font-sans"><div>Shell</div></div><code>ls\n  a</code></div>': "```bash\nls\n  a\n```", '<div data-markdown-copy="code-block"><div class="font-sans"><div>Plain text</div></div><code>t</code></div>': "```\nt\n```",
    '<pre><code class="hljs language-sql">z</code></pre>': "```sql\nz\n```", '<pre data-language="js"><code>w</code></pre>': "```js\nw\n```", 'a <span data-markdown-copy="inline-code">f(x)</span>': "a `f(x)`", "<ul><li><input type=checkbox checked> done</li><li><input type=checkbox>open</li><li>no box</li></ul>": "- [x] done\n- [ ] open\n- no box",
}
PILLS = {
    '<span data-testid="webpage-citation-pill"><a href="https://a.example"><img src="f"><span class="truncate">Site [A]</span><span>+2</span></a></span>': "[Site \\[A\\] +2](https://a.example)", '<span data-testid="webpage-citation-pill">no link</span>x': "x",
}


@pytest.mark.parametrize("forms", [MATH, CODE, PILLS], ids=["math", "code", "pills"])
def test_content_of_chatgpt(spark, forms):
    got = read(spark, "chatgpt", *(turn(f'<div class="markdown">{h}</div>') for h in forms))
    assert [[x.strip() for x in r.texte.splitlines() if x.strip()] for r in got] == [[x.strip() for x in w.splitlines() if x.strip()] for w in forms.values()]


def test_parts_of_a_turn(spark):
    pill = '<span data-testid="webpage-citation-pill"><a {}="https://b"><span class="truncate">B +1</span></a></span>'
    around = (
        '<button>Thought for 5s</button><div><p>because  of</p><p>that</p></div><button>Share</button><button>Worked for 2s</button>' + pill.format("alt") + pill.format("href")
        + '<div class="group"><button aria-label="Look it up">x</button><div data-testid="cot-v5-tool-icon-pile"></div></div><div class="group">Ran <b>code</b><div data-testid="cot-v5-tool-icon-pile"></div></div>'
        + '<div id="textdoc-message-1"><span class="font-semibold">My text</span><div contenteditable="true"><p>of a canvas</p></div></div>'
    )
    tiles = '<button class="group/file-tile" aria-label="a.pdf"></button><span class="x-resource-card"><a href="/f/1">go</a><span title="b.csv">b…</span></span><button class="group/file-tile" aria-label="a.pdf"></button><img src="https://images.openai.com/z" alt="Z"><img src="https://other/y">'
    user, answer = read(spark, "chatgpt", turn(f'<div class="whitespace-pre-wrap">see</div>{tiles}', role="user") + turn('<div class="markdown">said</div>', around))
    assert user.texte == "see\n\n![Z](https://images.openai.com/z)\n\na.pdf\n\n[b.csv](/f/1)" and (user.tools, user.sources, user.reasoning) == ([], [], "")
    assert answer.texte == "said\n\nof a canvas" and answer.reasoning == "because of\nthat\n\nWorked for 2s"
    assert (answer.tools, answer.sources, answer.artifacts, answer.message_id) == (["Look it up", "Ran code"], ["B — https://b"], ["My text"], "m")
    heads = '<div class="z-activity-header-1"><button aria-labelledby="k"></button><span id="k">Worked for 3s</span></div><div class="activity-header"><span class="truncate">Search</span></div><div class="activity-header"><span>x</span><div class="MarkdownRoot-1">Read  it</div></div>'
    one = read(spark, "chatgpt", turn('<div class="markdown">a</div>', heads))[0]
    assert (one.reasoning, one.tools) == ("Worked for 3s", ["Search", "Read it"])


def test_gemini_pages(spark):
    user = "<user-query><div class='query-text'><span class='cdk-visually-hidden'>You said</span>Q</div><div data-test-id='uploaded-file'><button aria-label='n.txt'></button></div><div data-test-id='uploaded-file'><span class='filename-label'>d</span><span class='extension-label'>JSON</span></div><img src='https://lh3.googleusercontent.com/gg/1' alt='p.png'><img src='icon'></user-query>"
    code = "<code-block><div class='code-block-decoration'>Python</div><pre><code>x</code></pre></code-block><code-block><div class='code-block-decoration'>Extrait de code</div><pre><code>y</code></pre></code-block><code-block><div class='code-block-decoration'>Output</div><pre><code class='code-result-container'>1</code></pre></code-block><mat-divider>-</mat-divider>"
    file = "<generated-file><img src='https://drive-thirdparty.googleusercontent.com/32'><span class='file-name-lr' title='out.csv'>out…</span><button>Open</button></generated-file>"
    chips = "<source-inline-chip><button aria-label='Voir la citation de JSON: d.json. Appuyer pour'></button></source-inline-chip><source-inline-chip><button aria-label='citations de A, B et C'></button></source-inline-chip><source-inline-chip><span class='source-title'>Site</span><a href='https://s'>x</a></source-inline-chip><source-inline-chip><span class='source-title'>Only</span></source-inline-chip><sources-list><a href='https://l'>Long title</a><a href='https://s'>s</a></sources-list>"
    answer = f"<model-response><message-content><div class='model-response-text'><p>A <span data-math='z'>z</span><i aria-hidden='true'>icon</i></p>{code}{file}<svg-code-block><span class='svg-label'>Plan</span><svg width='1'><g></g></svg></svg-code-block></div></message-content>{chips}<generated-image></generated-image></model-response>"
    got = read(spark, "gemini", f"<div class='conversation-container'>{user}<span class='luminous-video-duration-pill'>1:00</span>{answer}</div>")
    assert got[0].texte == "Q\n\n![p.png](https://lh3.googleusercontent.com/gg/1)\n\nn.txt\n\nd.json"
    assert got[1].texte == "A $z$\n\n```python\nx\n```\n\n```\ny\n```\n\n```\n1\n```\n\nout.csv\n\n```svg\n<svg width=\"1\"><g></g></svg>\n```"
    assert got[1].sources == ["JSON: d.json", "A", "B", "C", "Site — https://s", "Only", "Long title — https://l", "https://s"]
    assert (got[1].artifacts, got[1].tools) == (["Plan"], ["Exécution de code", "Génération d'images", "Canvas", "Analyse vidéo"])


def test_perplexity_pages(spark):
    user = "<div class='group/user-bubble'>Q<button>notes.txt</button><button>Copy</button><span role=button title='https://link'>li…</span></div><div data-asset-chip title='photo.png'></div><div data-asset-chip aria-label='x.pdf'></div><div data-asset-chip title='Y'><img src='https://y'></div>"
    cite = "<span class='citation' data-pplx-citation-url='https://a'><span aria-label='A title of some length'>a+1</span></span><span class='citation' data-pplx-citation-url='https://b'><span aria-label='short'>b</span></span><span class='citation' data-pplx-citation-url='https://a'></span>"
    body = f"<div data-renderer=lm><p>One{cite}</p><pre><figcaption><span>yaml 1</span></figcaption><code>k: v</code></pre><ul><li><span data-pplx-task-checkbox><button aria-checked=true></button></span>done</li><li><span data-pplx-task-checkbox><button></button></span>open</li></ul></div><div data-renderer=lm>Two</div>"
    card = "<div class='group relative'><div class='font-bold'>notes</div><div class='text-secondary'>YAML</div><button aria-label=\"Options de l'artefact\"></button></div>"
    answer = f"<div><div data-workflow-final-text><div class='x-step-header'><span title='Recherche terminée'></span><span title='Check files'></span>Recherche</div>{body}{card}<div data-testid='image-carousel-img'><img src='https://g' alt='G'></div><img src='https://no'></div><div data-testid='sources'><a href='https://c' title='C'>c</a><a href='https://d'>A long enough title here</a></div></div>"
    got = read(spark, "perplexity", f"<div data-workflow-entry=1>{user}{answer}</div>")
    assert got[0].texte == "Q https://link\n\nnotes.txt\n\n![photo.png](photo.png)\n\nx.pdf\n\n![Y](https://y)".replace("Q https", "Qhttps")
    assert got[1].texte == "One\n\n```yaml\nk: v\n```\n\n- [x] done\n- [ ] open\n\nTwo\n\n![G](https://g)"
    assert got[1].sources == ["A title of some length — https://a", "https://b", "C — https://c", "A long enough title here — https://d"]
    assert (got[1].artifacts, got[1].reasoning) == (["notes.yaml"], "Check files")


@pytest.mark.parametrize("platform", sorted(pages.PAGES))
def test_odd_pages(spark, platform):
    assert read(spark, platform, None, "", "<p>nothing", "<" * 500, "</div>" * 300) == []
