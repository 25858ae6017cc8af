"""From tokens to a tree: statements, verb phrases, and SQL clauses.

Verb phrases outside SQL read from right to left without precedence; inside clauses
``or``, ``and``, ``not``, comparisons, sums, products and signs have the usual one.
Trees are tuples whose first item names the node.
"""

from __future__ import annotations

from tessera.errors import BracketError, DepthError, NestedClauseError, ParseError
from tessera.plans.lexer import ADVERBS, Token, tokens

MAX_DEPTH = 100
_CLOSES = {"(": ")", "[": "]", "{": "}"}
COMPARISONS = ("=", "==", "!=", "<>", "<", "<=", ">", ">=")
#: Verbs of the drive: read, read on use, write, write as a directory.
DRIVE = ("<<", "<<=", ">>", ">>=")
#: Words that end a list of clauses' items and so are no names given to them.
_AFTER_ITEMS = ("having",)


def check_brackets(ts: list[Token]) -> int:
    """The deepest nesting; an error if brackets don't match or nest too deeply."""
    stack, deepest = [], 0
    for t in ts:
        if t.kind == "open":
            stack.append(t)
            deepest = max(deepest, len(stack))
            if deepest > MAX_DEPTH:
                raise DepthError(f"more than {MAX_DEPTH} brackets deep at {t.start}")
        elif t.kind == "close":
            if not stack:
                raise BracketError(f"{t.text} at {t.start} closes nothing")
            if _CLOSES[stack[-1].text] != t.text:
                raise BracketError(f"{stack[-1].text} at {stack[-1].start} is closed by {t.text} at {t.start}")
            stack.pop()
    if stack:
        raise BracketError(f"{stack[-1].text} at {stack[-1].start} is not closed")
    return deepest


class Parser:
    def __init__(self, text: str) -> None:
        self.text = text
        self.ts = tokens(text)
        check_brackets(self.ts)
        self.at = 0

    # ------------------------------------------------------------------- moving

    def peek(self, k: int = 0) -> Token | None:
        i = self.at + k
        return self.ts[i] if i < len(self.ts) else None

    def is_(self, kind: str, text: str | None = None, k: int = 0) -> bool:
        t = self.peek(k)
        return t is not None and t.kind == kind and (text is None or t.text.lower() == text)

    def take(self, kind: str | None = None, text: str | None = None) -> Token:
        t = self.peek()
        if t is None or (kind and t.kind != kind) or (text and t.text.lower() != text):
            raise ParseError(f"expected {text or kind}, got {t.text if t else 'the end'}")
        self.at += 1
        return t

    def skip(self, *kinds: str) -> None:
        while self.peek() and self.peek().kind in kinds:
            self.at += 1

    def word(self, *names: str) -> bool:
        """Takes a plain word of SQL that the language itself doesn't reserve."""
        if self.is_("name") and self.peek().text.lower() in names:
            self.at += 1
            return True
        return False

    # --------------------------------------------------------------- statements

    def program(self) -> tuple:
        return ("block", self.statements(None))

    def statements(self, until: str | None) -> list[tuple]:
        out = []
        self.skip("semicolon", "newline")
        while self.peek() and not (until and self.is_("close", until)):
            out.append(self.statement())
            if self.peek() and not self.is_("semicolon") and not self.is_("newline") and not (until and self.is_("close", until)):
                raise ParseError(f"unexpected {self.peek().text} at {self.peek().start}")
            self.skip("semicolon", "newline")
        return out

    def statement(self) -> tuple:
        if self.is_("sql"):
            return self.sql()
        if self.is_("control"):
            return self.control()
        if self.is_("name") and self.is_("colon", None, 1):
            name = self.take().text
            self.take()
            return ("assign", name, None, None, self.value())
        if self.is_("name") and self.is_("verb", None, 1) and self.is_("colon", None, 2):
            name, verb = self.take().text, self.take().text
            self.take()
            return ("assign", name, None, verb, self.value())
        if self.is_("name") and self.is_("open", "[", 1):
            back = self.at
            name = self.take().text
            index = self.bracketed("[", "]")
            verb = self.take().text if self.is_("verb") and self.is_("colon", None, 1) else None
            if self.is_("colon"):
                self.take()
                return ("assign", name, index, verb, self.value())
            self.at = back
        if self.is_("name") and self.is_("verb", None, 1) and self.peek(1).text in DRIVE:
            name, verb = self.take().text, self.take().text
            return ("drive", verb, name, self.phrase())
        return self.phrase()

    def value(self) -> tuple:
        return self.sql() if self.is_("sql") else self.phrase()

    def control(self) -> tuple:
        word = self.take("control").text.lower()
        if word in ("def", "function"):
            name = self.take("name").text
            names = [x[1] for x in self.bracketed("(", ")")]
            return ("def", name, names, self.curly())
        if word == "return":
            return ("return", self.value())
        if word == "if":
            self.take("open", "(")
            test = self.phrase()
            self.take("close", ")")
            yes = self.body()
            mark = self.at
            self.skip("newline")
            no = None
            if self.is_("control", "else"):
                self.take()
                no = ("block", [self.control()]) if self.is_("control", "if") else self.body()
            else:
                self.at = mark
            return ("if", test, yes, no)
        if word == "while":
            self.take("open", "(")
            test = self.phrase()
            self.take("close", ")")
            return ("while", test, self.body())
        if word == "do":
            self.take("open", "(")
            times = self.phrase()
            self.take("close", ")")
            return ("do", times, self.body())
        if word == "for":
            self.take("open", "(")
            parts = []
            for k in range(3):
                parts.append(self.statement())
                self.take("semicolon") if k < 2 else self.take("close", ")")
            return ("for", *parts, self.body())
        if word in ("self", "this"):
            self.at -= 1
            return self.phrase()
        raise ParseError(f"{word} stands alone")

    def body(self) -> tuple:
        self.skip("newline")
        return self.curly() if self.is_("open", "{") else ("block", [self.statement()])

    def curly(self) -> tuple:
        self.take("open", "{")
        out = self.statements("}")
        self.take("close", "}")
        return ("block", out)

    # -------------------------------------------------------------- verb phrases

    def phrase(self) -> tuple:
        """noun [verb phrase] | verb phrase, right to left."""
        if self.is_("verb"):
            verb = self.take().text
            if self.is_("adverb"):
                return ("adverb", self.take().value, ("verb", verb), None, self.phrase())
            return ("monad", verb, self.phrase())
        left = self.noun()
        if self.is_("adverb"):  # a function with an adverb, such as f \/ v
            return ("adverb", self.take().value, left, None, self.phrase())
        if self.is_("verb"):
            verb = self.take().text
            if self.is_("adverb"):
                return ("adverb", self.take().value, ("verb", verb), left, self.phrase())
            return ("dyad", verb, left, self.phrase())
        return left

    def bracketed(self, start: str, end: str) -> list[tuple]:
        self.take("open", start)
        out = []
        self.skip("newline")
        while not self.is_("close", end):
            out.append(self.value())
            self.skip("newline")
            if not self.is_("close", end):
                if not (self.is_("comma") or self.is_("semicolon")):
                    raise ParseError(f"expected , or {end} at {self.peek().start}")
                self.take()
                self.skip("newline")
        self.take("close", end)
        return out

    def atom(self) -> tuple:
        t = self.peek()
        if t is None:
            raise ParseError("the text ends early")
        if t.kind in ("number", "string", "symbol", "constant", "datetime", "date", "time", "span"):
            self.at += 1
            return (t.kind, t.value)
        if t.kind == "name" or (t.kind == "control" and t.value in ("self", "this")):
            self.at += 1
            return ("name", t.text)
        if t.kind == "open":
            if t.text == "(":
                inside = self.bracketed("(", ")")
                return inside[0] if len(inside) == 1 else ("list", inside)
            if t.text == "[":
                return ("list", self.bracketed("[", "]"))
            return self.lambda_()
        raise ParseError(f"unexpected {t.text} at {t.start}")

    def noun(self) -> tuple:
        out = self.atom()
        alike = out[0] == "number"
        while self.peek():
            if self.is_("open", "["):
                out = ("index", out, self.bracketed("[", "]"))
            elif self.is_("open", "(") and out[0] in ("name", "lambda", "call"):
                out = ("call", out, self.bracketed("(", ")"))
            elif alike and self.is_("number"):  # numbers side by side are a vector
                items = [out]
                while self.is_("number"):
                    items.append((self.peek().kind, self.take().value))
                out, alike = ("list", items), False
            else:
                break
        return out

    def lambda_(self) -> tuple:
        self.take("open", "{")
        names = [x[1] for x in self.bracketed("[", "]")] if self.is_("open", "[") else ["x"]
        out = self.statements("}")
        self.take("close", "}")
        return ("lambda", names, ("block", out))

    # ----------------------------------------------------------------------- SQL

    def sql(self) -> tuple:
        start = self.take("sql").text.lower()
        return getattr(self, f"_{start}")()

    def _clauses(self, out: dict) -> dict:
        while True:
            self.skip("newline")
            if self.is_("name", "having") and "having" not in out:
                self.take()
                out["having"] = self._list()
                continue
            if not self.is_("clause"):
                if self.is_("sql"):
                    raise NestedClauseError(f"{self.peek().text} at {self.peek().start} needs brackets")
                return out
            word = self.take().text.lower()
            if word in out:
                raise ParseError(f"{word} comes twice")
            if word == "from":
                out[word] = self._sources()
            elif word == "where":
                out[word] = self._list()
            elif word == "group":
                self.word("by")
                out[word] = self._grouping_sets() if self.is_("name", "grouping") and self.is_("name", "sets", 1) else self._items()
            elif word == "order":
                self.word("by")
                out[word] = self._ordering()
            elif word == "limit":
                out[word] = self._expr()
            elif word == "on":
                out[word] = self._list()
            elif word == "set":
                out[word] = self._changes()
            elif word == "values":
                out[word] = self._rows()

    def _select(self) -> tuple:
        once = self.is_("name", "distinct") and not self.is_("open", "(", 1)
        if once:
            self.take()
        items = [] if self.is_("clause") or self.is_("newline") else self._items()
        clauses = self._clauses({})
        return ("select", items, clauses | {"distinct": True} if once else clauses)

    def _grouping_sets(self) -> list[tuple]:
        self.take()
        self.take()
        self.take("open", "(")
        sets = []
        while True:
            if self.is_("open", "("):
                self.take()
                sets.append([] if self.is_("close", ")") else self._list())
                self.take("close", ")")
            else:
                sets.append([self._expr()])
            if not self.is_("comma"):
                break
            self.take()
        self.take("close", ")")
        return [(("sets", sets), None)]

    def _insert(self) -> tuple:
        self.word("into")
        name = self.take("name").text
        self.skip("newline")
        rest = self._clauses({}) if self.is_("clause") else {"select": self.sql()}
        return ("insert", name, rest)

    def _upsert(self) -> tuple:
        self.word("into")
        name = self.take("name").text
        self.skip("newline")
        rest: dict = {}
        if self.is_("open", "("):
            self.take()
            rest["select"] = self.sql()
            self.take("close", ")")
        return ("upsert", name, self._clauses(rest))

    def _update(self) -> tuple:
        name = self.take("name").text
        return ("update", name, self._clauses({}))

    def _delete(self) -> tuple:
        return ("delete", self._clauses({}))

    def _items(self) -> list[tuple]:
        out = []
        while True:
            self.skip("newline")
            if self.is_("verb", "*"):
                self.take()
                out.append((("star",), None))
            else:
                e = self._expr()
                name = None
                if self.word("as") or (self.is_("name") and self.peek().text.lower() not in _AFTER_ITEMS):
                    name = self.take("name").text
                out.append((e, name))
            if not self.is_("comma"):
                return out
            self.take()

    def _list(self) -> list[tuple]:
        out = [self._expr()]
        while self.is_("comma"):
            self.take()
            out.append(self._expr())
        return out

    def _sources(self) -> list[tuple]:
        """Each source is (tree, name, how it is joined, on); the first is joined to nothing."""
        out, how = [], None
        while True:
            self.skip("newline")
            if self.is_("open", "("):
                self.take()
                source: tuple = self.sql()
                self.take("close", ")")
            else:
                source = ("name", self.take("name").text)
            name = self.take("name").text if self.word("as") else None
            on = None
            if how is not None and self.is_("clause", "on"):
                self.take()
                on = self._list()
            out.append((source, name, how, on))
            if self.is_("comma"):
                self.take()
                how = "comma"
                continue
            words: list[str] = []
            while self.is_("name") and self.peek().text.lower() in ("left", "right", "full", "semi", "anti", "cross", "outer", "inner"):
                words.append(self.take().text.lower())
            if self.word("join"):
                how = "_".join(words) or "inner"
                continue
            if words:
                raise ParseError(f"expected join after {' '.join(words)}")
            return out

    def _ordering(self) -> list[tuple]:
        out = []
        while True:
            e = self._expr()
            down = self.word("desc")
            if not down:
                self.word("asc")
            out.append((e, down))
            if not self.is_("comma"):
                return out
            self.take()

    def _changes(self) -> list[tuple]:
        out = []
        while True:
            self.skip("newline")
            name = self.take("name").text
            if self.is_("colon") or self.is_("verb", "="):
                self.take()
            else:
                raise ParseError(f"expected : or = after {name}")
            out.append((name, self._expr()))
            if not self.is_("comma"):
                return out
            self.take()

    def _rows(self) -> list[list[tuple]]:
        out = []
        while True:
            self.skip("newline")
            self.take("open", "(")
            row = [self._expr()]
            while self.is_("comma"):
                self.take()
                row.append(self._expr())
            self.take("close", ")")
            out.append(row)
            if not self.is_("comma"):
                return out
            self.take()

    # ----------------------------------------------------- expressions of clauses

    def _expr(self) -> tuple:
        left = self._and()
        while self.word("or") or self._verb("|"):
            left = ("or", left, self._and())
        return left

    def _verb(self, *texts: str) -> str | None:
        if self.is_("verb") and self.peek().text in texts:
            return self.take().text
        return None

    def _and(self) -> tuple:
        left = self._not()
        while self.word("and") or self._verb("&"):
            left = ("and", left, self._not())
        return left

    def _not(self) -> tuple:
        if self.word("not") or self._verb("!"):
            return ("not", self._not())
        return self._comparison()

    def _comparison(self) -> tuple:
        if self.is_("name", "exists") and self.is_("open", "(", 1) and self.is_("sql", None, 2):
            self.take()
            self.take()
            inner = self.sql()
            self.take("close", ")")
            return ("exists", inner)
        left = self._sum()
        op = self._verb(*COMPARISONS)
        if op:
            return ("dyad", op, left, self._sum())
        negated = self.word("not")
        out = None
        if self.word("in"):
            out = ("in", left, self._in_items())
        elif self.word("between"):
            low = self._sum()
            if not self.word("and"):
                raise ParseError("between needs and")
            out = ("between", left, low, self._sum())
        elif self.word("like"):
            out = ("like", left, self._sum())
        elif self.word("rlike"):
            out = ("rlike", left, self._sum())
        elif self.word("is"):
            no = self.word("not")
            if self.take("constant").value is not None:
                raise ParseError("is needs null")
            out = ("isnull", left)
            negated = negated or no
        elif negated:
            raise ParseError("not stands where an operator should")
        if out is None:
            return left
        return ("not", out) if negated else out

    def _in_items(self) -> tuple:
        self.take("open", "(")
        if self.is_("sql"):
            inner: tuple = self.sql()
        else:
            inner = ("list", self._list())
        self.take("close", ")")
        return inner

    def _sum(self) -> tuple:
        left = self._product()
        while op := self._verb("+", "-"):
            left = ("dyad", op, left, self._product())
        return left

    def _product(self) -> tuple:
        left = self._power()
        while op := self._verb("*", "/", "%"):
            left = ("dyad", op, left, self._power())
        return left

    def _power(self) -> tuple:
        left = self._sign()
        if self._verb("**"):
            return ("dyad", "**", left, self._power())
        return left

    def _sign(self) -> tuple:
        if self._verb("-"):
            return ("monad", "-", self._sign())
        return self._operand()

    def _operand(self) -> tuple:
        if self.is_("open", "(") and self.is_("sql", None, 1):
            self.take()
            out: tuple = ("scalar", self.sql())
            self.take("close", ")")
            return out
        if self.is_("open", "("):
            self.take()
            out = self._expr()
            self.take("close", ")")
        elif self.is_("name") and self.is_("open", "(", 1):
            name = self.take().text
            self.take()
            args: list[tuple] = []
            if self.is_("verb", "*"):
                self.take()
                args = [("star",)]
            elif not self.is_("close", ")"):
                args = self._list()
            self.take("close", ")")
            out = ("call", ("name", name), args)
            if self.is_("name", "over") and self.is_("open", "(", 1):
                out = self._over(out)
        elif self.word("case"):
            return self._case()
        else:
            out = self.atom()
        while self.is_("open", "["):
            out = ("index", out, self.bracketed("[", "]"))
        return out

    def _over(self, call: tuple) -> tuple:
        """over (partition by .. order by .. rows between .. and ..)"""
        self.take()
        self.take("open", "(")
        part: list[tuple] = []
        order: list[tuple] = []
        frame = None
        if self.word("partition"):
            self.word("by")
            part = self._list()
        if self.is_("clause", "order"):
            self.take()
            self.word("by")
            order = self._ordering()
        kind = "rows" if self.word("rows") else "range" if self.word("range") else None
        if kind:
            if self.word("between"):
                low = self._bound()
                if not self.word("and"):
                    raise ParseError("between needs and")
                frame = (kind, low, self._bound())
            else:
                frame = (kind, self._bound(), 0)
        self.take("close", ")")
        return ("over", call, part, order, frame)

    def _bound(self) -> int | None:
        """Rows after the current one; None if unbounded, with its side told by place."""
        if self.word("current"):
            if not self.word("row"):
                raise ParseError("current needs row")
            return 0
        n = None if self.word("unbounded") else self.take("number").value
        if self.word("preceding"):
            return None if n is None else -n
        if not self.word("following"):
            raise ParseError("a bound is preceding or following")
        return n

    def _case(self) -> tuple:
        arms, other = [], None
        while self.word("when"):
            test = self._expr()
            if not self.word("then"):
                raise ParseError("when needs then")
            arms.append((test, self._expr()))
        if self.is_("control", "else"):
            self.take()
            other = self._expr()
        if not self.word("end"):
            raise ParseError("case needs end")
        return ("case", arms, other)


def parse(text: str) -> tuple:
    """The tree of a program."""
    return Parser(text).program()


def nodes(tree, depth: int = 0):
    """(depth, name, text) of every named node of a tree, in order; for inspection."""
    if isinstance(tree, tuple) and tree and isinstance(tree[0], str):
        plain = [x for x in tree[1:] if not isinstance(x, (tuple, list, dict))]
        yield depth, tree[0], " ".join(str(x) for x in plain)
        for x in tree[1:]:
            yield from nodes(x, depth + 1)
    elif isinstance(tree, dict):
        for k, v in tree.items():
            yield depth, k, ""
            yield from nodes(v, depth + 1)
    elif isinstance(tree, (tuple, list)):
        for x in tree:
            yield from nodes(x, depth)


__all__ = ["ADVERBS", "Parser", "check_brackets", "nodes", "parse"]
