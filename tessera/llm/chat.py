"""Chat formatting by a template compiler.

A template of a small sandboxed language is parsed to a syntax tree, constants are folded, and the rest becomes Python
closures that write a conversation and note where generated text stands. The language has output ``{{ expr }}``,
``{% for x in expr %}``, ``{% if %} {% elif %} {% else %}`` and ``{% generation %}``, names, fields, strings, numbers, ``==``,
``!=``, ``and``, ``or``, ``not``, ``+`` and the filters ``escape`` and ``trim``. Nothing else can be named or called.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each turn opens with its role and closes with a mark; only the assistant's own words are generated.
TEMPLATE = """{% for turn in turns %}<|{{ turn.role | escape }}|>
{% if turn.role == "assistant" %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}<|end|>
{% endfor %}"""

#: What an escaped text may not hold: a bar beside a pointed bracket, and the marks of other common formats.
CONTROL = re.compile(r"\\|(?<=<)\||\|(?=>)|<(?=/?s>)|\[(?=/?INST\])")
SAFE = {"\\": "\\\\", "|": "\\p", "<": "\\l", "[": "\\b"}
PLAIN = {v: k for k, v in SAFE.items()}


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: SAFE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: PLAIN[m[0]], text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip}
TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|()+]))""")


class Expression:
    """A recursive-descent parser of expressions into tuples, the first item of which is the kind; constants are folded."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise ValueError(f"can't read {source[at:]!r} in a template")
            kind = m.lastindex
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"{self.tokens[self.at][1]!r} isn't expected in a template")
        return tree

    def chain(self, below: Callable[[], tuple], *ops: str) -> tuple:
        tree = below()
        while op := self.take(*ops):
            tree = fold((op, tree, below()))
        return tree

    def either(self) -> tuple:
        return self.chain(self.both, "or")

    def both(self) -> tuple:
        return self.chain(self.negated, "and")

    def negated(self) -> tuple:
        return fold(("not", self.negated())) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        return self.chain(self.summed, "==", "!=")

    def summed(self) -> tuple:
        return self.chain(self.filtered, "+")

    def filtered(self) -> tuple:
        tree = self.single()
        while self.take("|"):
            kind, name = self.tokens[self.at]
            if name not in FILTERS:
                raise ValueError(f"{name!r} isn't a filter")
            self.at += 1
            tree = fold(("filter", name, tree))
        return tree

    def single(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise ValueError("a bracket isn't closed in a template")
            return tree
        if self.at == len(self.tokens):
            raise ValueError("an expression ends early in a template")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == 2:
            return ("const", int(text))
        if kind != 3:
            raise ValueError(f"{text!r} isn't expected in a template")
        tree = ("const", text == "true") if text in ("true", "false") else ("name", text)
        while self.take("."):
            tree = ("field", tree, self.tokens[self.at][1])
            self.at += 1
        return tree


BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "+": lambda a, b: a + b}


def fold(tree: tuple) -> tuple:
    """The value of a tree whose parts are constants."""
    parts = [x for x in tree[1:] if isinstance(x, tuple)]
    return ("const", evaluator(tree)({})) if parts and all(x[0] == "const" for x in parts) else tree


def evaluator(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env, value=tree[1]: value
    if kind == "name":
        return lambda env, name=tree[1]: env[name]
    if kind == "field":
        owner, name = evaluator(tree[1]), tree[2]
        return lambda env: owner(env)[name]
    if kind == "filter":
        apply, inner = FILTERS[tree[1]], evaluator(tree[2])
        return lambda env: apply(str(inner(env)))
    if kind == "not":
        inner = evaluator(tree[1])
        return lambda env: not inner(env)
    op, a, b = BINARY[kind], evaluator(tree[1]), evaluator(tree[2])
    if kind in ("and", "or"):
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    return lambda env: op(a(env), b(env))


def parse(template: str) -> list[tuple]:
    """The syntax tree of a template, constants folded: text, output, if, for and generation nodes."""
    pieces = [x for x in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S) if x]
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                tree = Expression(piece[2:-2]).whole()
                nodes.append(("text", str(tree[1])) if tree[0] == "const" else ("output", tree))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return merged(nodes), f"{word} {rest}".strip()
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip())
                    if not m:
                        raise ValueError(f"can't read {piece!r}")
                    body, _ = block("endfor")
                    nodes.append(("for", m[1], Expression(m[2]).whole(), body))
                elif word == "if":
                    nodes += choice(rest)
                elif word == "generation":
                    body, _ = block("endgeneration")
                    nodes.append(("generation", body))
                else:
                    raise ValueError(f"{piece!r} isn't known or has no beginning")
            else:
                nodes.append(("text", piece))
        if ends:
            raise ValueError(f"a template lacks {ends[0]}")
        return merged(nodes), ""

    def choice(source: str) -> list[tuple]:
        test = Expression(source).whole()
        yes, end = block("elif", "else", "endif")
        no: list[tuple] = []
        if end.startswith("elif"):
            no = choice(end[4:])
        elif end == "else":
            no, _ = block("endif")
        if test[0] == "const":
            return yes if test[1] else no
        return [("if", test, yes, no)]

    return block()[0]


def merged(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


class Page:
    """What closures write to."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def writer(nodes: list[tuple]) -> Callable[[dict, Page], None]:
    steps = [step(node) for node in nodes]

    def run(env: dict, page: Page) -> None:
        for s in steps:
            s(env, page)

    return steps[0] if len(steps) == 1 else run


def step(node: tuple) -> Callable[[dict, Page], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, page, text=node[1]: page.write(text)
    if kind == "output":
        value = evaluator(node[1])
        return lambda env, page: page.write(str(value(env)))
    if kind == "if":
        test, yes, no = evaluator(node[1]), writer(node[2]), writer(node[3])
        return lambda env, page: (yes if test(env) else no)(env, page)
    if kind == "for":
        name, items, body = node[1], evaluator(node[2]), writer(node[3])

        def loop(env: dict, page: Page) -> None:
            for item in items(env):
                body({**env, name: item}, page)

        return loop
    body = writer(node[1])

    def generation(env: dict, page: Page) -> None:
        begin = page.size
        body(env, page)
        page.spans.append((begin, page.size))

    return generation


def compiled(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from turns (role, text) to the formatted text and the spans of generated text."""
    run = writer(parse(template))

    def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        page = Page()
        run({"turns": turns}, page)
        return "".join(page.parts), page.spans

    return render


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans): one row for each conversation, spans as structs of begin and end in code points.

    Turns are put in the order of turn, then role, then text; null turns first. A null role or text is empty. Rows with
    a null conv_id make one conversation. Repeated rows are repeated turns, in ties of turn they go by role and text. An empty table
    gives no rows, texts of any length are written whole. Other columns are not read, whatever their names.
    """
    parse(template)  # an error in it is told here, not in a task

    def work(batches):
        render = compiled(template)
        for batch in batches:
            done = [render([{"role": t["role"], "text": t["text"]} for t in list_]) for list_ in batch["turns"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "formatted": [x for x, _ in done], "spans": [[{"begin": a, "end": b} for a, b in s] for _, s in done]})

    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role, text))).alias("turns"))
    return listed.mapInPandas(work, f"conv_id {kind}, formatted string, spans array<struct<begin:long,end:long>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a text that TEMPLATE has made."""
    out, at = [], 0
    while at < len(formatted):
        begin = formatted.index("|>\n", at + 2)
        end = formatted.index("<|end|>\n", begin + 3)
        out.append((unescape(formatted[at + 2 : begin]), unescape(formatted[begin + 3 : end])))
        at = end + 8
    return out
