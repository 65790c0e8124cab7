"""Syntax-tree features of Java methods: a small recursive-descent parser and 28 numeric features.

The node names and nesting follow the usual Java syntax-tree libraries: a compilation unit holds the class, which holds
its members; a child is one deeper than its parent, and lists add no depth. Exact node totals of another library
are not promised; the counted statement and expression nodes are. Texts that do not parse give all zeros.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The counted node types and the feature order.
COUNTED = (
    "MethodDeclaration IfStatement ForStatement WhileStatement DoStatement SwitchStatement ReturnStatement MethodInvocation VariableDeclarator "
    "LocalVariableDeclaration Assignment BinaryOperation Literal TryStatement CatchClause ThrowStatement ClassCreator MemberReference "
    "StatementExpression BlockStatement"
).split()
FEATURES = [
    "parse_success", "total_nodes", "max_depth", *(f"n_{n}" for n in COUNTED), "n_parameters",
    "ratio_control_flow", "ratio_method_invocations", "ratio_assignments", "ratio_returns",
]
CONTROL = ("IfStatement", "ForStatement", "WhileStatement", "DoStatement", "SwitchStatement")
PRIMITIVE = frozenset("boolean byte char short int long float double void".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
LEVELS = [{"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {"<", ">", "<=", ">=", "instanceof"}, {"<<", ">>", ">>>"}, {"+", "-"}, {"*", "/", "%"}]
BINARY = {op: i for i, level in enumerate(LEVELS) for op in level}
LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<lit>\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'"
    r"|(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[fFdDlL]?)"
    r"|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|==|!=|<=|>=|&&|\|\||[-+*/%&|^]=|<<|[{}()\[\];,.?:+\-*/%<>=!&|^~@])",
    re.S,
)


class ParseError(Exception):
    pass


class Node:
    __slots__ = ("kind", "children", "parameters")

    def __init__(self, kind: str, *children):
        self.kind, self.children, self.parameters = kind, [c for c in children if c is not None], 0

    def walk(self) -> Iterator[tuple["Node", int]]:
        stack = [(self, 1)]
        while stack:
            node, depth = stack.pop()
            yield node, depth
            for c in reversed(node.children):
                stack.extend((x, depth + 1) for x in (reversed(c) if isinstance(c, list) else (c,)) if isinstance(x, Node))


def lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        m = LEX.match(source, at)
        if not m:
            raise ParseError(f"character {source[at]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class Parser:
    """Parses a compilation unit of classes; every method consumes its construct or raises ParseError."""

    def __init__(self, source: str):
        self.tokens = lex(source) + [("end", "")] * 4
        self.at = 0
        self.depth = 0

    @property
    def text(self) -> str:
        kind, text = self.tokens[self.at]
        return text if kind != "lit" else ""

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def ahead(self, k: int) -> str:
        kind, text = self.tokens[min(self.at + k, len(self.tokens) - 1)]
        return text if kind != "lit" else ""

    def take(self, text: str | None = None) -> str:
        if self.kind == "end" or (text is not None and self.text != text):
            raise ParseError(f"{text!r} expected at token {self.at}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def on(self, *texts: str) -> bool:
        if self.text in texts and self.kind != "lit":
            self.at += 1
            return True
        return False

    def name(self) -> str:
        if self.kind != "word":
            raise ParseError(f"name expected at token {self.at}")
        return self.take()

    def attempt(self, rule):
        mark = self.at
        try:
            return rule()
        except ParseError:
            self.at = mark
            return None

    def unit(self) -> Node:
        types = []
        while self.kind != "end":
            types.append(self.declaration())
        return Node("CompilationUnit", types)

    def modifiers(self) -> list[Node]:
        notes = []
        while True:
            if self.text == "@" and self.ahead(1) != "interface":
                self.take()
                self.qualified()
                if self.text == "(":
                    self.balanced("(", ")")
                notes.append(Node("Annotation"))
            elif self.text in MODIFIERS and not (self.text == "default" and self.ahead(1) in (":", "->")) and not (self.text == "synchronized" and self.ahead(1) == "("):
                self.take()
            else:
                return notes

    def balanced(self, a: str, b: str) -> None:
        depth = 0
        while True:
            depth += (self.text == a) - (self.text == b)
            self.take()
            if not depth:
                return

    def qualified(self) -> str:
        out = self.name()
        while self.text == "." and self.tokens[self.at + 1][0] == "word":
            self.take()
            out += "." + self.name()
        return out

    def declaration(self) -> Node:
        notes = self.modifiers()
        if self.text in ("class", "interface", "enum", "record") or (self.text == "@" and self.ahead(1) == "interface"):
            self.on("@")
            kind = self.take()
            self.name()
            self.type_parameters()
            if kind == "record":
                self.balanced("(", ")")
            supers = []
            while self.on("extends", "implements", "permits"):
                supers.append(self.type())
                while self.on(","):
                    supers.append(self.type())
            return Node({"class": "ClassDeclaration", "enum": "EnumDeclaration", "record": "RecordDeclaration"}.get(kind, "InterfaceDeclaration"), notes, supers, self.body(kind == "enum"))
        raise ParseError("class expected")

    def body(self, enum: bool = False) -> list[Node]:
        self.take("{")
        out: list[Node] = []
        if enum:
            while self.kind == "word" or self.text == "@":
                self.modifiers()
                self.name()
                arguments = self.arguments() if self.text == "(" else []
                out.append(Node("EnumConstantDeclaration", arguments, self.body() if self.text == "{" else None))
                if not self.on(","):
                    break
            self.on(";")
        while not self.on("}"):
            if not self.on(";"):
                out.append(self.member())
        return out

    def type_parameters(self) -> list[Node]:
        out = []
        if self.on("<"):
            while True:
                self.modifiers()
                self.name()
                bounds = []
                while self.on("extends", "&"):
                    bounds.append(self.type())
                out.append(Node("TypeParameter", bounds))
                if not self.on(","):
                    break
            self.take(">")
        return out

    def type(self) -> Node:
        self.modifiers()
        if self.text in PRIMITIVE:
            self.take()
            out = Node("BasicType")
        elif self.on("?"):
            return Node("TypeArgument", self.type() if self.on("extends", "super") else None)
        else:
            self.name()
            out = Node("ReferenceType", self.type_arguments())
            while self.text == "." and self.tokens[self.at + 1][0] == "word":
                self.take()
                self.name()
                out.children.append(Node("ReferenceType", self.type_arguments()))
        while self.text == "[" and self.ahead(1) == "]":
            self.at += 2
        return out

    def type_arguments(self) -> list[Node]:
        out: list[Node] = []
        if self.text == "<":
            self.take()
            while self.text != ">":
                inner = self.type()
                out.append(inner if inner.kind == "TypeArgument" else Node("TypeArgument", inner))
                while self.on("&"):
                    self.type()
                if not self.on(","):
                    break
            self.take(">")
        return out

    def member(self) -> Node:
        notes = self.modifiers()
        if self.text == "{":
            return Node("BlockStatement", self.block())
        if self.text in ("class", "interface", "enum", "@") or (self.text == "record" and self.ahead(2) in ("(", "<")):
            return self.declaration()
        generics = self.type_parameters()
        if self.kind == "word" and self.ahead(1) == "(":
            self.name()
            parameters = self.parameters()
            return Node("ConstructorDeclaration", notes, generics, parameters, self.throws(), self.block())
        result = None if self.text == "void" else self.type()
        if result is None:
            self.take()
        self.name()
        if self.text == "(":
            parameters = self.parameters()
            self.dimensions()
            self.throws()
            if self.on("default"):
                self.expression()
            body = self.block() if self.text == "{" else None
            if body is None:
                self.take(";")
            out = Node("MethodDeclaration", notes, generics, result, parameters, body)
            out.parameters = len(parameters)
            return out
        out = Node("FieldDeclaration", notes, result, self.declarators())
        self.take(";")
        return out

    def dimensions(self) -> None:
        while self.on("["):
            self.take("]")

    def throws(self) -> None:
        if self.on("throws"):
            self.type()
            while self.on(","):
                self.type()

    def parameters(self) -> list[Node]:
        self.take("(")
        out = []
        while self.text != ")":
            notes = self.modifiers()
            kind = self.type()
            self.on("...")
            self.name()
            self.dimensions()
            out.append(Node("FormalParameter", notes, kind))
            if not self.on(","):
                break
        self.take(")")
        return out

    def declarators(self) -> list[Node]:
        """After the first name."""
        out = []
        while True:
            self.dimensions()
            out.append(Node("VariableDeclarator", self.initialiser() if self.on("=") else None))
            if not self.on(","):
                return out
            self.name()

    def initialiser(self) -> Node:
        return self.array_initialiser() if self.text == "{" else self.expression()

    def array_initialiser(self) -> Node:
        self.take("{")
        out = []
        while self.text != "}":
            out.append(self.initialiser())
            if not self.on(","):
                break
        self.take("}")
        return Node("ArrayInitializer", out)

    def block(self) -> list[Node]:
        self.take("{")
        out = []
        while not self.on("}"):
            out.append(self.block_item())
        return out

    def block_item(self) -> Node:
        mark = self.at
        notes = self.modifiers()
        if self.text in ("class", "interface", "enum") or (self.text == "record" and self.ahead(2) in ("(", "<")):
            return self.declaration()
        local = self.attempt(lambda: self.local(notes))
        if local is not None:
            self.take(";")
            return local
        self.at = mark
        return self.statement()

    def local(self, notes: list[Node]) -> Node:
        if self.text in ("return", "throw", "new", "yield", "else", "case", "assert", "break", "continue", "this", "super"):
            raise ParseError("no declaration")
        kind = self.type()
        self.name()
        if self.text not in ("=", ";", ",", "[", ":"):
            raise ParseError("no declaration")
        return Node("LocalVariableDeclaration", notes, kind, self.declarators())

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > 150:
            raise ParseError("nesting too deep")
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def condition(self) -> Node:
        self.take("(")
        out = self.expression()
        self.take(")")
        return out

    def _statement(self) -> Node:
        word = self.text
        if word == "{":
            return Node("BlockStatement", self.block())
        if self.on(";"):
            return Node("Statement")
        if self.on("if"):
            test, then = self.condition(), self.statement()
            return Node("IfStatement", test, then, self.statement() if self.on("else") else None)
        if self.on("while"):
            return Node("WhileStatement", self.condition(), self.statement())
        if self.on("do"):
            body = self.statement()
            self.take("while")
            test = self.condition()
            self.take(";")
            return Node("DoStatement", test, body)
        if self.on("for"):
            control = self.for_control()
            return Node("ForStatement", control, self.statement())
        if word == "switch":
            return self.switch()
        if self.on("try"):
            return self.try_statement()
        if word in ("return", "throw") or (word == "yield" and self.ahead(1) not in ("=", ".", "(", "++", "--")):
            self.take()
            value = None if self.text == ";" else self.expression()
            self.take(";")
            return Node({"return": "ReturnStatement", "throw": "ThrowStatement"}.get(word, "YieldStatement"), value)
        if self.on("break", "continue"):
            if self.kind == "word":
                self.name()
            self.take(";")
            return Node("BreakStatement" if word == "break" else "ContinueStatement")
        if self.on("assert"):
            test = self.expression()
            more = self.expression() if self.on(":") else None
            self.take(";")
            return Node("AssertStatement", test, more)
        if word == "synchronized":
            self.take()
            return Node("SynchronizedStatement", self.condition(), self.block())
        if self.kind == "word" and self.ahead(1) == ":" and word not in ("default",):
            self.at += 2
            return self.statement()
        out = Node("StatementExpression", self.expression())
        self.take(";")
        return out

    def for_control(self) -> Node:
        self.take("(")

        def each() -> Node:
            notes = self.modifiers()
            kind = self.type()
            self.name()
            self.take(":")
            return Node("EnhancedForControl", Node("VariableDeclaration", notes, kind, Node("VariableDeclarator")), self.expression())

        out = self.attempt(each)
        if out is None:
            notes = self.modifiers()
            first: list | Node | None = None
            if self.text != ";":
                first = self.attempt(lambda: self.local(notes))
                if first is not None:
                    first.kind = "VariableDeclaration"
                else:
                    first = self.expressions()
            self.take(";")
            test = None if self.text == ";" else self.expression()
            self.take(";")
            out = Node("ForControl", first, test, [] if self.text == ")" else self.expressions())
        self.take(")")
        return out

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.on(","):
            out.append(self.expression())
        return out

    def switch(self) -> Node:
        self.take("switch")
        test = self.condition()
        self.take("{")
        cases = []
        while not self.on("}"):
            labels = []
            if self.on("case"):
                labels.append(self.ternary())
                while self.on(","):
                    labels.append(self.ternary())
            else:
                self.take("default")
            body: list[Node] = []
            if self.on("->"):
                body.append(self.statement())
            else:
                self.take(":")
                while self.text not in ("case", "default", "}"):
                    body.append(self.block_item())
            cases.append(Node("SwitchStatementCase", labels, body))
        return Node("SwitchStatement", test, cases)

    def try_statement(self) -> Node:
        resources = []
        if self.on("("):
            while self.text != ")":
                notes = self.modifiers()

                def named(notes=notes) -> Node:
                    kind = self.type()
                    self.name()
                    self.take("=")
                    return Node("TryResource", notes, kind, self.expression())

                found = self.attempt(named)
                resources.append(found if found is not None else Node("TryResource", self.expression()))
                if not self.on(";"):
                    break
            self.take(")")
        body, catches, last = self.block(), [], []
        while self.on("catch"):
            self.take("(")
            notes = self.modifiers()
            self.type()
            while self.on("|"):
                self.type()
            self.name()
            self.take(")")
            catches.append(Node("CatchClause", Node("CatchClauseParameter", notes), self.block()))
        if self.on("finally"):
            last = self.block()
        elif not catches and not resources:
            raise ParseError("catch expected")
        return Node("TryStatement", resources, body, catches, last)

    def expression(self) -> Node:
        self.depth += 1
        if self.depth > 150:
            raise ParseError("nesting too deep")
        try:
            function = self.lambda_expression()
            if function is not None:
                return function
            left = self.ternary()
            if self.text == ">" and self.ahead(1) in (">", ">="):  # shift-assignments are lexed apart for generics
                return left
            if self.text in ASSIGN and self.kind != "lit":
                self.take()
                return Node("Assignment", left, self.expression())
            return left
        finally:
            self.depth -= 1

    def lambda_expression(self) -> Node | None:
        def head() -> list[Node]:
            if self.kind == "word" and self.ahead(1) == "->":
                self.take()
                self.take("->")
                return [Node("InferredFormalParameter")]
            if self.text != "(":
                raise ParseError("no lambda")
            typed = self.attempt(self.parameters)
            if typed is None:
                self.take("(")
                typed = []
                while self.text != ")":
                    self.name()
                    typed.append(Node("InferredFormalParameter"))
                    if not self.on(","):
                        break
                self.take(")")
            self.take("->")
            return typed

        if self.text != "(" and self.ahead(1) != "->":
            return None
        parameters = self.attempt(head)
        if parameters is None:
            return None
        return Node("LambdaExpression", parameters, self.block() if self.text == "{" else self.expression())

    def ternary(self) -> Node:
        test = self.binary(0)
        if self.on("?"):
            yes = self.expression()
            self.take(":")
            return Node("TernaryExpression", test, yes, self.lambda_expression() or self.ternary())
        return test

    def operator(self) -> tuple[str, int]:
        """Binary operator at the cursor and its number of tokens (shifts to the right are lexed as single signs)."""
        if self.kind == "lit":
            return "", 0
        if self.text == ">" and self.ahead(1) == ">" and self.ahead(2) == ">":
            return ">>>", 3
        if self.text == ">" and self.ahead(1) == ">":
            return ">>", 2
        return self.text, 1

    def binary(self, level: int) -> Node:
        left = self.unary()
        while True:
            op, size = self.operator()
            rank = BINARY.get(op, -1)
            if rank < level:
                return left
            self.at += size
            if op == "instanceof":
                self.on("final")
                right = self.type()
                if self.kind == "word" and self.text not in BINARY:
                    self.name()
            else:
                right = self.binary(rank + 1)
            left = Node("BinaryOperation", left, right)

    def unary(self) -> Node:
        if self.text in ("+", "-", "!", "~", "++", "--") and self.kind != "lit":
            self.take()
            return self.unary()
        if self.text == "(":
            cast = self.attempt(self.cast)
            if cast is not None:
                return cast
        return self.postfix(self.primary())

    def cast(self) -> Node:
        self.take("(")
        kind = self.type()
        while self.on("&"):
            self.type()
        self.take(")")
        basic = kind.kind == "BasicType"
        starts = self.kind in ("word", "lit") and self.text not in ("instanceof",) or self.text in ("(", "!", "~") or (basic and self.text in ("+", "-", "++", "--"))
        if not starts:
            raise ParseError("no cast")
        return Node("Cast", kind, self.lambda_expression() or self.unary())

    def arguments(self) -> list[Node]:
        self.take("(")
        out = [] if self.text == ")" else self.expressions()
        self.take(")")
        return out

    def primary(self) -> Node:
        if self.kind == "lit" or self.text in ("true", "false", "null"):
            self.take()
            return Node("Literal")
        if self.on("("):
            out = self.expression()
            self.take(")")
            return out
        if self.text == "switch":
            return self.switch()
        if self.text in ("this", "super"):
            word = self.take()
            if self.text == "(":
                return Node("ExplicitConstructorInvocation" if word == "this" else "SuperConstructorInvocation", self.arguments())
            return Node("This" if word == "this" else "SuperMemberReference")
        if self.on("new"):
            return self.creator()
        if self.text in PRIMITIVE:
            kind = self.type()
            if self.on("."):
                self.take("class")
            return Node("ClassReference", kind)
        generic = self.attempt(self.generic_reference)
        if generic is not None:
            return generic
        self.name()
        while self.text == "." and self.tokens[self.at + 1][0] == "word" and self.ahead(1) not in ("new", "this", "super", "class"):
            self.take()
            self.name()
        if self.text == "(":
            return Node("MethodInvocation", self.arguments())
        if self.text == "." and self.ahead(1) in ("class", "this"):
            self.at += 2
            return Node("ClassReference")
        if self.text == "[" and self.ahead(1) == "]":
            self.dimensions()
            if self.on("."):
                self.take("class")
            return Node("ClassReference")
        return Node("MemberReference")

    def generic_reference(self) -> Node:
        """Type arguments before ``::``."""
        kind = self.type()
        if self.text != "::" or not kind.children or not kind.children[0]:
            raise ParseError("no reference")
        return kind

    def creator(self) -> Node:
        self.modifiers()
        if self.text in PRIMITIVE:
            self.take()
            kind = Node("BasicType")
        else:
            self.qualified()
            kind = Node("ReferenceType", self.type_arguments())
            while self.on("."):
                self.name()
                kind.children.append(Node("ReferenceType", self.type_arguments()))
        if self.text == "[":
            sizes = []
            while self.on("["):
                if self.text != "]":
                    sizes.append(self.expression())
                self.take("]")
            return Node("ArrayCreator", kind, sizes, self.array_initialiser() if self.text == "{" else None)
        arguments = self.arguments()
        return Node("ClassCreator", kind, arguments, self.body() if self.text == "{" else None)

    def postfix(self, node: Node) -> Node:
        selectors: list[Node] = []
        while True:
            if self.on("["):
                selectors.append(Node("ArraySelector", self.expression()))
                self.take("]")
            elif self.text == "." and self.ahead(1) == "new":
                self.at += 2
                selectors.append(self.creator())
            elif self.text == ".":
                self.take()
                self.type_arguments()
                self.name()
                selectors.append(Node("MethodInvocation", self.arguments()) if self.text == "(" else Node("MemberReference"))
            elif self.on("::"):
                self.type_arguments()
                self.name()
                node = Node("MethodReference", node)
            elif self.on("++", "--"):
                continue
            else:
                break
        if selectors:
            node.children.append(selectors)
        return node


def parse(code: str | None) -> Node | None:
    """Tree of a method in a dummy class, or None if it does not parse."""
    try:
        return Parser(f"public class Dummy {{\n{(code or '').strip()}\n}}\n").unit()
    except (ParseError, RecursionError):
        return None


def features(code: str | None) -> dict[str, float]:
    """The 28 features: one count over the preorder nodes, and ratios of the counts; all zero when the text does not
    parse."""
    tree = parse(code)
    if tree is None:
        return dict.fromkeys(FEATURES, 0.0)
    kinds, depths = zip(*((node.kind, depth) for node, depth in tree.walk()))
    seen, total = Counter(kinds), len(kinds)
    methods = (node for node, _ in tree.walk() if node.kind == "MethodDeclaration")
    counts = {f"n_{kind}": seen[kind] for kind in COUNTED}
    shares = {
        "ratio_control_flow": sum(seen[kind] for kind in CONTROL),
        "ratio_method_invocations": seen["MethodInvocation"],
        "ratio_assignments": seen["Assignment"],
        "ratio_returns": seen["ReturnStatement"],
    }
    found = {"parse_success": 1, "total_nodes": total, "max_depth": max(depths), "n_parameters": getattr(next(methods, None), "parameters", 0)}
    found |= counts | {name: n / total for name, n in shares.items()}
    return {name: float(found[name]) for name in FEATURES}


FEATURE_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in FEATURES])


@F.pandas_udf(FEATURE_TYPE)
def _features(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features(c) for c in code], columns=FEATURES)


def tree_features(code: Column) -> Column:
    """Struct of the 28 features, in Arrow batches."""
    return _features(code)


def tree_vector(code: Column) -> Column:
    """The features as an array in their fixed order."""
    s = tree_features(code)
    return F.array(*(s[n] for n in FEATURES))
