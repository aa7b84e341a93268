"""The per-statement helper: the items of one statement to the nodes in it.

Spark cuts files into items, pairs brackets and finds statements; this helper
sees one statement, with each block in it as a single item, and orders its
expressions by precedence.  Signatures and types stay text.  A node is (kind,
first item, item after the last, fields, attrs); a field is a node, a list of
nodes with holes, or null.  The statements of a block join their node's list
``stmts`` later, in Spark.
"""

from __future__ import annotations

import re

from coppice.functions.literals import number, typed, unquoted

MAX_DEPTH = 120
#: Binary operators: binding power (odd ones group to the right) and kind.
BINARY = {
    "or": (2, "LogicalOr"), "xor": (4, "LogicalXor"), "and": (6, "LogicalAnd"), "??": (9, "Coalesce"), "||": (10, "BooleanOr"), "&&": (12, "BooleanAnd"), "|": (14, "BitwiseOr"), "^": (16, "BitwiseXor"),
    "&": (18, "BitwiseAnd"), "==": (20, "Equal"), "!=": (20, "NotEqual"), "<>": (20, "NotEqual"), "===": (20, "Identical"), "!==": (20, "NotIdentical"), "<=>": (20, "Spaceship"), "<": (22, "Smaller"),
    "<=": (22, "SmallerOrEqual"), ">": (22, "Greater"), ">=": (22, "GreaterOrEqual"), ".": (24, "Concat"), "<<": (26, "ShiftLeft"), ">>": (26, "ShiftRight"), "+": (28, "Plus"), "-": (28, "Minus"),
    "*": (30, "Mul"), "/": (30, "Div"), "%": (30, "Mod"), "instanceof": (34, "Instanceof"), "**": (37, "Pow"),
}
TERNARY, VALUE, NOT, SIGN = 8, 7, 32, 36
ASSIGN = {"=": "", "+=": "Plus", "-=": "Minus", "*=": "Mul", "/=": "Div", ".=": "Concat", "%=": "Mod", "&=": "And", "|=": "Or", "^=": "Xor", "<<=": "ShiftLeft", ">>=": "ShiftRight", "**=": "Pow", "??=": "Coalesce"}
PREFIX = {"!": "BooleanNot", "-": "UnaryMinus", "+": "UnaryPlus", "~": "BitwiseNot", "@": "ErrorSuppress", "++": "PreInc", "--": "PreDec", "&": "Reference", "...": "Spread"}
WORDED = {"print": "Print", "clone": "Clone", "include": "Include", "include_once": "IncludeOnce", "require": "Require", "require_once": "RequireOnce", "throw": "Throw", "yield": "Yield"}
MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "readonly", "var")
CASTS = ("int", "integer", "float", "double", "string", "bool", "boolean", "array", "object", "unset", "binary")
#: Statements by their first word.  With a header in brackets: its fields.  With a body alone: further fields.  With values: their field.
HEADED = {"if": ("If", ("cond",)), "elseif": ("ElseIf", ("cond",)), "while": ("While", ("cond",)), "switch": ("Switch", ("cond",)), "for": ("For", ("init", "cond", "loop")), "foreach": ("Foreach", ()), "catch": ("Catch", ()), "declare": ("Declare", ("declares",))}
BODIES = {"do": ("Do", {"while": None}), "try": ("TryCatch", {"catches": [], "finally": None}), "finally": ("Finally", {}), "else": ("Else", {})}
VALUES = {"return": ("Return", "expr"), "break": ("Break", "num"), "continue": ("Continue", "num"), "goto": ("Goto", "label"), "echo": ("Echo", "exprs"), "<?=": ("Echo", "exprs"), "global": ("Global", "vars"), "unset": ("Unset", "vars"), "const": ("Const", "consts")}
#: Declarations whose text up to the block or semicolon is their signature.
SIGNED = {"class": "Class", "interface": "Interface", "trait": "Trait", "enum": "Enum", "namespace": "Namespace", "use": "Use"}
_VARIABLE = re.compile(rb"(?<!\\)(?:\\\\)*(?:\{\$|\$\{?)([A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)")


class Bad(Exception):
    """A syntax error at an item."""


class Statement:
    """Precedence climbing over the items (type, text) of one statement."""

    def __init__(self, items: list[tuple[str, str]]):
        self.items, self.i, self.depth = items, 0, 0

    def peek(self, ahead: int = 0) -> str:
        """The text of an operator, {} for a block, else the type; end behind the last."""
        kind, text = self.items[self.i + ahead] if self.i + ahead < len(self.items) else ("end", "")
        return text if kind == "op" else "{}" if kind == "block" else kind

    def word(self, ahead: int = 0) -> str:
        return self.items[self.i + ahead][1].lower() if self.peek(ahead) == "name" else ""

    def had(self, *kinds: str) -> bool:
        if self.peek() in kinds or self.word() in kinds:
            self.i += 1
            return True
        return False

    def take(self, kind: str) -> None:
        if not self.had(kind):
            found = self.items[self.i][1].encode("latin-1").decode("utf-8", "replace") if self.i < len(self.items) else "end of statement"
            raise Bad(f"unexpected {found!r}, expected {kind}")

    def node(self, kind: str, at: int, fields: dict | None = None, attrs: dict | None = None) -> tuple:
        return kind, at, self.i, fields or {}, attrs or {}

    def raw(self, at: int, glue: str = "") -> bytes:
        return glue.join(t for _, t in self.items[at : self.i]).encode("latin-1")

    def until(self, *stops: str) -> bytes:
        """The text up to one of ``stops`` outside brackets opened here."""
        at, depth = self.i, 0
        while self.peek() != "end" and (depth or self.peek() not in stops):
            if self.peek() == "{}":
                self.take(";")
            depth += {"(": 1, "[": 1, "{": 1, "#[": 1, ")": -1, "]": -1, "}": -1}.get(self.peek(), 0)
            self.i += 1
        return self.raw(at, " ")

    def nested(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Bad("nesting too deep")

    # -- statements
    def whole(self) -> tuple | None:
        made = self.statement()
        if self.i < len(self.items):
            self.take("end of statement")
        return made

    def closed(self, kind: str, at: int, fields: dict, attrs: dict | None = None) -> tuple:
        """With the semicolon, which a statement before ``?>`` or the end of a block lacks."""
        if self.peek() != "end":
            self.take(";")
        return self.node(f"Stmt_{kind}", at, fields, attrs)

    def body(self) -> list:
        """A block (whose statements come later), nothing, or one statement."""
        made = None if self.had("{}", ";") or self.peek() == "end" else self.statement()
        return [made] if made else []

    def statement(self) -> tuple | None:
        self.nested()
        at = self.i
        while self.peek() == "#[":
            self.attribute()
        if self.had(";") or self.peek() == "end":
            return None
        made = self.node("Stmt_Block", at, {"stmts": []}) if self.had("{}") else self.declared(at) or self.worded(at)
        if made is None and self.peek() == "name" and self.peek(1) == ":":
            self.i += 2
            stmts = self.body()
            made = self.node("Stmt_Label", at, {"stmts": stmts}, {"name": self.items[at][1]})
        if made is None:
            expr = self.expr()
            if self.word() in ("as", "insteadof"):  # how a class takes a method of a trait: stays text
                self.until(";")
            made = self.closed("Expression", at, {"expr": expr})
        self.depth -= 1
        return made

    def attribute(self) -> None:
        self.i += 1
        self.until("]")
        self.take("]")

    def declared(self, at: int) -> tuple | None:
        """Functions, classes and properties, with their modifiers."""
        here = self.i
        while self.word() in MODIFIERS and self.peek(1) in ("name", "var", "?", "(") and self.word(1) != "fn" and (self.word(1), self.peek(2)) != ("function", "("):
            self.i += 1
        flags, word = self.raw(here, " ").lower(), self.word()
        attrs = {"flags": flags} if flags else {}
        if word == "function" and (self.peek(1) == "name" or self.peek(2) == "name"):
            self.i += 1
            return self.function("Stmt_Function", at, attrs)
        if word in SIGNED and self.peek(1) in ("name", "{}"):
            self.i += 1
            attrs |= {"signature": self.until("{}", ";")}
            return self.node(f"Stmt_{SIGNED[word]}", at, {"stmts": []}, attrs) if self.had("{}") else self.closed(SIGNED[word], at, {}, attrs)
        if not flags or word == "const":
            return None
        kind = self.until("var", ";")
        return self.closed("Static" if flags == b"static" and not kind else "Property", at, {"vars": self.listed(";")}, attrs | ({"type": kind} if kind else {}))

    def worded(self, at: int) -> tuple | None:
        """Statements that a keyword begins."""
        word = self.word()
        if word == "else" and self.word(1) == "if":
            self.i += 1
            word = "elseif"
        if word in HEADED and self.peek(1) == "(":
            kind, names = HEADED[word]
            self.i += 2
            fields: dict = {}
            if word == "foreach":
                fields = {"expr": self.expr()}
                self.take("as")
                key, value = self.pair()
                fields |= {"keyVar": key, "valueVar": value}
            elif word == "catch":
                self.until("var", ")")
                fields = {"var": self.expr() if self.peek() == "var" else None}
            for name in names:
                fields[name] = self.expr() if names == ("cond",) else self.listed(";" if name != names[-1] else ")")
                if name != names[-1]:
                    self.take(";")
            self.take(")")
            fields["stmts"] = self.body()
            return self.node(f"Stmt_{kind}", at, fields | ({"elseifs": [], "else": None} if word == "if" else {}))
        if word in BODIES:
            self.i += 1
            kind, more = BODIES[word]
            stmts = self.body()
            return self.node(f"Stmt_{kind}", at, {"stmts": stmts} | more)
        if word in VALUES and self.peek(1) not in ("::", ":"):
            kind, field = VALUES[word]
            self.i += 1
            bracketed = word == "unset" and self.had("(")
            values = self.listed(")" if bracketed else ";")
            if bracketed:
                self.take(")")
            return self.closed(kind, at, {field: values if field.endswith("s") else (values or [None])[0]})
        if word in ("case", "default") and self.peek(1) != "::":
            self.i += 1
            fields = {"cond": self.expr() if word == "case" else None, "stmts": []}
            return self.node("Stmt_Case", at, fields) if self.had(":") else self.closed("Case", at, fields)
        if word == "__halt_compiler":
            self.i = len(self.items)
            return self.node("Stmt_HaltCompiler", at)
        return None

    def function(self, kind: str, at: int, attrs: dict) -> tuple:
        """From the name, or the bracket of one without; types stay text."""
        self.had("&")
        if self.had("name"):
            attrs = attrs | {"name": self.items[self.i - 1][1]}
        self.take("(")
        params: list = []
        while self.peek() not in (")", "end"):
            here, kind_of = self.i, self.until("var", ")")
            var = self.expr(SIGN)
            params.append(self.node("Param", here, {"var": var, "default": self.expr() if self.had("=") else None}, {"type": kind_of} if kind_of else {}))
            if not self.had(","):
                break
        self.take(")")
        fields: dict = {"params": params}
        if self.had("use"):
            self.take("(")
            fields["uses"] = self.listed(")")
            self.take(")")
        if self.had(":"):
            attrs = attrs | {"returnType": self.until("{}", ";", "=>")}
        if self.had("=>"):
            return self.node(kind, at, fields | {"expr": self.expr()}, attrs)
        if not self.had("{}"):
            return self.closed(kind.removeprefix("Stmt_"), at, fields | {"stmts": None}, attrs)
        return self.node(kind, at, fields | {"stmts": []}, attrs)

    # -- expressions
    def listed(self, stop: str, holes: bool = False, of=None) -> list:
        """Expressions up to ``stop``; with ``holes`` a missing one is null."""
        out: list = []
        while self.peek() not in (stop, "end"):
            if holes and self.had(","):
                out.append(None)
                continue
            out.append(of() if of else self.expr())
            if not self.had(","):
                break
        return out

    def pair(self) -> tuple:
        key, value = None, self.expr()
        return (value, self.expr()) if self.had("=>") else (key, value)

    def item(self) -> tuple:
        at, (key, value) = self.i, self.pair()
        return self.node("ArrayItem", at, {"key": key, "value": value})

    def arg(self) -> tuple:
        at, named = self.i, self.peek() == "name" and self.peek(1) == ":"
        self.i += 2 * named
        value = None if self.peek() == "..." and self.peek(1) == ")" and self.had("...") else self.expr()
        return self.node("Arg", at, {"value": value}, {"name": self.items[at][1]} if named else {})

    def arm(self) -> tuple:
        at = self.i
        conds = None if self.had("default") else self.listed("=>")
        self.take("=>")
        body = self.expr()
        return self.node("MatchArm", at, {"conds": conds, "body": body})

    def within(self, close: str, holes: bool = False, of=None) -> list:
        """Behind an opening bracket, what stands up to and with the closing one."""
        self.i += 1
        out = self.listed(close, holes, of)
        self.take(close)
        return out

    def expr(self, least: int = 0) -> tuple:
        self.nested()
        at, left = self.i, self.unary()
        while True:
            op = self.word() or self.peek()
            if op in ASSIGN:
                self.i += 1
                right = self.expr(VALUE)
                left = self.node(f"Expr_Assign{ASSIGN[op]}", at, {"var": left, "expr": right})
            elif op == "?" and least <= TERNARY:
                self.i += 1
                middle = None if self.peek() == ":" else self.expr(VALUE)
                self.take(":")
                right = self.expr(TERNARY + 1)
                left = self.node("Expr_Ternary", at, {"cond": left, "if": middle, "else": right})
            elif op in BINARY and BINARY[op][0] >= least:
                power, kind = BINARY[op]
                self.i += 1
                right = self.expr(power if power % 2 else power + 1)
                left = self.node(f"Expr_{'' if kind == 'Instanceof' else 'BinaryOp_'}{kind}", at, {"left": left, "right": right})
            else:
                self.depth -= 1
                return left

    def unary(self) -> tuple:
        at, kind, word = self.i, self.peek(), self.word()
        if kind in PREFIX:
            self.i += 1
            inner = self.expr(NOT if kind == "!" else SIGN)
            return self.node(f"Expr_{PREFIX[kind]}", at, {"expr": inner})
        if kind == "(" and self.word(1) in CASTS and self.peek(2) == ")":
            self.i += 3
            inner = self.expr(SIGN)
            return self.node("Expr_Cast", at, {"expr": inner}, {"type": self.items[at + 1][1].lower()})
        if word in WORDED and self.peek(1) != "::":
            self.i += 1
            self.had("from")
            inner = None if self.peek() in (";", ")", ",", "]", "end") else self.item() if word == "yield" else self.expr(VALUE)
            return self.node(f"Expr_{WORDED[word]}", at, {"expr": inner})
        left = self.atom(at, kind, word)
        while (kind := self.peek()) in ("[", "(", "->", "?->", "::", "++", "--"):
            if kind == "[":
                dims = self.within("]")
                left = self.node("Expr_ArrayDimFetch", at, {"var": left, "dim": (dims or [None])[0]})
            elif kind == "(":
                args = self.within(")", of=self.arg)
                left = self.node("Expr_FuncCall", at, {"name": left, "args": args})
            elif kind in ("++", "--"):
                self.i += 1
                left = self.node("Expr_PostInc" if kind == "++" else "Expr_PostDec", at, {"var": left})
            else:
                self.i += 1
                member = self.within("}")[0] if self.peek() == "{" and self.peek(1) != "}" else self.atom(self.i, self.peek(), "")
                how = {"->": "", "?->": "Nullsafe", "::": "Static"}[kind]
                if self.peek() == "(":
                    args = self.within(")", of=self.arg)
                    left = self.node("Expr_StaticCall" if how == "Static" else f"Expr_{how}MethodCall", at, {"var": left, "name": member, "args": args})
                else:
                    left = self.node("Expr_ClassConstFetch" if how == "Static" and member[0] == "Name" else f"Expr_{how}PropertyFetch", at, {"var": left, "name": member})
        return left

    def atom(self, at: int, kind: str, word: str) -> tuple:
        if kind == "(":
            inner = self.within(")")
            if len(inner) != 1:
                raise Bad("expected one expression in brackets")
            return (*inner[0][:4], inner[0][4] | {"_parenthesized": True})
        if kind == "[":
            items = self.within("]", True, self.item)
            return self.node("Expr_Array", at, {"items": items}, {"_kind": 2})
        if word in ("array", "list", "isset", "empty", "exit", "die", "match") and self.peek(1) == "(":
            self.i += 1
            if word in ("array", "list"):
                items = self.within(")", True, self.item)
                return self.node("Expr_Array" if word == "array" else "Expr_List", at, {"items": items}, {"_kind": 1})
            inner = self.within(")")
            first = (inner or [None])[0]
            if word == "match":
                arms = self.within("}", of=self.arm)
                return self.node("Expr_Match", at, {"cond": first, "arms": arms})
            return self.node("Expr_Isset", at, {"vars": inner}) if word == "isset" else self.node("Expr_Empty" if word == "empty" else "Expr_Exit", at, {"expr": first})
        self.i += 1
        if word in ("exit", "die"):
            return self.node("Expr_Exit", at, {"expr": None})
        if kind == "$":
            inner = self.within("}")[0] if self.peek() == "{" and self.peek(1) != "}" else self.atom(self.i, self.peek(), "")
            return self.node("Expr_Variable", at, {"name": inner})
        if kind == "#[":
            self.i = at
            self.attribute()
            return self.unary()
        if word == "new":
            if self.had("class"):
                args = self.within(")", of=self.arg) if self.peek() == "(" else []
                signature = self.until("{}")
                self.take("{}")
                return self.node("Expr_New", at, {"args": args, "stmts": []}, {"signature": signature})
            of = self.atom(self.i, self.peek(), "")
            args = self.within(")", of=self.arg) if self.peek() == "(" else []
            return self.node("Expr_New", at, {"class": of, "args": args})
        if word == "static" and self.word() in ("function", "fn"):
            word = self.word()
            self.i += 1
        if word in ("function", "fn"):
            return self.function("Expr_Closure" if word == "function" else "Expr_ArrowFunction", at, {})
        raw = self.raw(at)
        if kind == "var":
            return self.node("Expr_Variable", at, attrs={"name": raw[1:]})
        if kind == "num":
            value = number(raw.decode())
            return self.node("Scalar_Int" if isinstance(value, int) else "Scalar_Float", at, attrs={"value": value, "_rawValue": raw})
        if kind == "str":
            quote = {b"'": 1, b'"': 2, b"`": 3}.get(raw[:1], 4)
            # What a string takes from variables is named, not parsed.
            used = _VARIABLE.findall(raw) if quote != 1 and not (quote == 4 and b"'" in raw.split(b"\n")[0]) else []
            attrs = {"value": raw[1:-1] if quote < 4 else raw, "variables": b" ".join(dict.fromkeys(used))} if used else {"value": unquoted(raw)}
            return self.node("Scalar_InterpolatedString" if used else "Scalar_String", at, attrs=attrs | {"_kind": quote})
        self.i -= 1
        self.take("name")
        name = self.node("Name", at, attrs={"name": raw})
        return name if self.peek() in ("(", "::") or self.items[at - 1][1] in ("->", "?->", "::", "new") else self.node("Expr_ConstFetch", at, {"name": name})


def nodes_of(items: list[tuple[str, str]]) -> tuple[list[dict], tuple[str, int] | None]:
    """The nodes of one statement in pre-order, and its error (message, item) if it has one.

    A row has kind, first and last item, field and pos in its parent, fields
    (name, many), holes (field, pos, and a scalar that stands there) and attrs.  A statement that can't be read
    is one node that keeps the blocks in it.
    """
    reader, error = Statement(items), None
    try:
        root = reader.whole()
    except Bad as e:
        error = str(e), min(reader.i, len(items) - 1)
        root = ("Stmt_Invalid", 0, len(items), {"stmts": []}, {})
    rows: list[dict] = []
    stack: list[tuple] = [(root, "stmts", None)] if root else []
    while stack:
        (kind, first, behind, fields, attrs), field, pos = stack.pop()
        flat: list[tuple] = []
        for f, v in fields.items():
            flat += [(x, f, i) for i, x in enumerate(v)] if isinstance(v, list) else [(v, f, None)]
        rows.append({
            "kind": kind, "first": first, "last": behind - 1, "field": field, "pos": pos, "attrs": [{"name": k, "value": typed(v)} for k, v in attrs.items()],
            "fields": [(f, isinstance(v, list)) for f, v in fields.items()], "holes": [(f, i, None if x is None else typed(x)) for x, f, i in flat if not isinstance(x, tuple) and i is not None],
        })
        stack += [x for x in reversed(flat) if isinstance(x[0], tuple)]
    return rows, error
