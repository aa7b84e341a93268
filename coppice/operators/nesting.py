"""Brackets, blocks and statements of source files, by windows over their items.

Everything is a window over the items of a file: depth is a running sum, the
partner of a bracket is its neighbour among the brackets of its level, and the
block that holds an item is the last one opened a level higher.  A colon after a
control header (or else) opens a block like a brace, and endif and the like
close it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.operators.lexing import PLACE

CONTROL = ("if", "elseif", "while", "for", "foreach", "switch", "declare")
ENDS = ("endif", "endwhile", "endfor", "endforeach", "endswitch", "enddeclare")
#: A block ends a statement that begins with one of these.
HEADS = (
    "if", "elseif", "else", "while", "for", "foreach", "switch", "do", "try", "catch", "finally", "function", "class", "interface", "trait", "enum", "namespace", "declare", "abstract",
    "final", "readonly", "public", "protected", "private", "static", "var", "case", "default", "use", "const", "#[", "",
)
#: Statements that go on with one before: their field in its node. Fields that are lists.
CHAINED = {"Stmt_ElseIf": "elseifs", "Stmt_Else": "else", "Stmt_Catch": "catches", "Stmt_Finally": "finally", "Stmt_While": "while"}
LISTED = ("elseifs", "catches")
#: Statements that may end in one without braces, and so reach as far as what goes on with that.
OPEN_ENDED = ("Stmt_If", "Stmt_ElseIf", "Stmt_Else", "Stmt_For", "Stmt_Foreach", "Stmt_While", "Stmt_Do", "Stmt_TryCatch", "Stmt_Declare", "Stmt_Label")


def _in_file(*more: str):
    return W.partitionBy("file_ord", *more).orderBy("at")


def _running(delta: Column) -> Column:
    return F.coalesce(F.sum(delta).over(_in_file().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")


def _neighbour(values: Column, shift: int) -> Column:
    return (F.lag if shift < 0 else F.lead)(values).over(_in_file())


def blocks(items: DataFrame) -> DataFrame:
    """Adds word, opens and closes (the bracket an item opens or closes, if any), and level, the depth around it.

    Brackets are paired twice: plain ones first, which tells what stands before
    a header's bracket and after it, and then with the colons of control headers.
    """
    text = F.col("text")
    op = F.col("type") == "op"
    df = items.withColumn("word", F.when(F.col("type") == "name", F.lower("text")).otherwise(""))
    df = df.withColumn("opens", F.when(op & text.isin("(", "[", "{", "#["), F.replace(text, F.lit("#"), F.lit("")))).withColumn("closes", F.when(op & text.isin(")", "]", "}"), F.translate(text, ")]}", "([{")))
    is_open, is_close = F.col("opens").isNotNull(), F.col("closes").isNotNull()
    df = df.withColumn("level", _running(is_open.cast("int") - is_close.cast("int")) - is_close.cast("int")).withColumn("bracket", is_open | is_close)
    df = df.withColumn("before", F.when(_neighbour(F.col("word"), -1) != "", _neighbour(F.col("word"), -1)).otherwise(_neighbour(text, -1))).withColumn("next", _neighbour(text, 1))
    pair = _in_file("level", "bracket")
    df = df.withColumn("head", F.when(is_close & F.col("bracket"), F.lag("before").over(pair))).withColumn("behind", F.when(is_open & F.col("bracket"), F.lead("next").over(pair)))
    # Now what stands before and after whole headers is known.
    headed, word = _neighbour(F.col("head"), -1), F.col("word")
    colon = op & (text == ":") & (headed.isin(*CONTROL) | (_neighbour(word, -1) == "else"))
    goes_on = ((word == "else") & (F.col("next") == ":")) | ((word == "elseif") & (_neighbour(F.col("behind"), 1) == ":"))
    plain_brace = F.col("before").isin("->", "?->", "::", "$") | F.col("before").endswith("\\") | (headed == "match")
    opens = F.when(colon, ":").when((text == "{") & op & F.coalesce(plain_brace, F.lit(False)), "m").otherwise(F.col("opens"))
    closes = F.when(word.isin(*ENDS) | goes_on, ":").otherwise(F.col("closes"))
    df = df.withColumn("new_opens", opens).withColumn("closes", closes).drop("opens", "head", "behind", "next", "before").withColumnRenamed("new_opens", "opens")
    return df.withColumn("level", _running(is_open.cast("int") - is_close.cast("int")) - is_close.cast("int")).withColumn("bracket", is_open | is_close)


def checked(df: DataFrame) -> DataFrame:
    """Adds partner (place and mark of the bracket's other half), opened (what a closing bracket's other half opens) and wrong, whether an item can't stand where it is."""
    pair = _in_file("level", "bracket")
    after = F.struct(F.col("closes").alias("mark"), (F.col("closes").isNotNull() & (F.col("word").isin("else", "elseif"))).alias("goes_on"), *PLACE)
    df = df.withColumn("partner", F.when(F.col("opens").isNotNull(), F.lead(after).over(pair))).withColumn("opened", F.when(F.col("closes").isNotNull(), F.lag("opens").over(pair)))
    same = lambda a, b: F.coalesce((a == b) | ((a == "m") & (b == "{")), F.lit(False))
    unpaired = (F.col("opens").isNotNull() & ~same(F.col("opens"), F.col("partner.mark"))) | (F.col("closes").isNotNull() & ~same(F.col("opened"), F.col("closes")))
    stray = (F.col("type") == "op") & F.col("text").rlike(r"^(?:['\"`\\]|[^\x20-\x7e])$")
    return df.withColumn("wrong", unpaired | stray | (F.col("type") == "open"))


def without_broken(df: DataFrame) -> DataFrame:
    """The items before the statement that holds a file's first wrong one, that one as an item of type error, and all HTML."""
    whole = W.partitionBy("file_ord")
    df = df.withColumn("first", F.min(F.when(F.col("wrong"), F.col("at"))).over(whole))
    top = (F.col("level") == 0) & (F.col("text").isin(";", "}") | F.col("type").isin("term", "html"))
    df = df.withColumn("last", F.coalesce(F.max(F.when(top & (F.col("at") < F.col("first")), F.col("at"))).over(whole), F.lit(-1)))
    kept = df.where("first is null or at <= last or at = first or type = 'html'")
    # What is left behind the error stands at the top.
    behind = F.col("first").isNotNull() & (F.col("at") > F.col("last"))
    kind = F.when(F.col("at") == F.col("first"), F.when(F.col("opens").isNotNull() | (F.col("type") == "open"), "unclosed").otherwise("unexpected")).otherwise(F.col("type"))
    kept = kept.withColumns({"type": kind, "level": F.when(behind, 0).otherwise(F.col("level")), "opens": F.when(~behind, F.col("opens")), "closes": F.when(~behind, F.col("closes"))})
    return kept.drop("first", "last", "wrong")


def statements(df: DataFrame) -> DataFrame:
    """(file_ord, block, stmt, type, text, word, and PLACE, at): items with the block and statement they are in.

    ``block`` is the place of the opening brace, -1 at the top.  A block is one
    item of the statement it belongs to (type block, with its whole place).
    """
    is_block = F.col("opens").isin("{", ":") & (F.col("type") == "op")
    ends_block = F.col("closes").isin("{", ":")
    # Braces that hold expressions close like others; they are told by their partner's mark.
    ends_block = ends_block & ~F.coalesce(F.col("opened") == "m", F.lit(False))
    df = df.withColumn("opens_block", F.coalesce(is_block, F.lit(False))).withColumn("ends_block", F.coalesce(ends_block, F.lit(False)))
    df = df.withColumn("depth", _running(F.col("opens_block").cast("int") - F.col("ends_block").cast("int")) - F.col("ends_block").cast("int"))
    # Each item at depth d looks for the last block opened at depth d - 1.
    own = F.struct((F.col("depth") - 1).alias("key"), F.lit(False).alias("gives"))
    both = df.withColumn("role", F.explode(F.when(F.col("opens_block"), F.array(own, F.struct(F.col("depth").alias("key"), F.lit(True).alias("gives")))).otherwise(F.array(own)))).select("*", "role.key", "role.gives")
    holder = F.last(F.when(F.col("gives"), F.struct("at", "level")), ignorenulls=True).over(_in_file("key").rowsBetween(W.unboundedPreceding, 0))
    held = both.withColumn("holder", holder).where("not gives").withColumn("block", F.coalesce("holder.at", F.lit(-1).cast("long")))
    held = held.withColumn("outer", F.col("level") == F.coalesce(F.col("holder.level") + 1, F.lit(0)))
    # A closing mark belongs to its block; else and elseif also begin what follows.
    held = held.where("not ends_block or word in ('else', 'elseif')")
    upto = lambda c: F.when(F.col("partner.goes_on"), F.col(f"partner.{c.removeprefix('end_') if c != 'end' else 'start'}")).otherwise(F.col(f"partner.{c}"))
    whole = {c: F.when(F.col("opens_block"), upto(c)).otherwise(F.col(c)) for c in PLACE[3:]}
    held = held.withColumns(whole | {"type": F.when(F.col("opens_block"), "block").otherwise(F.col("type"))})
    stream = _in_file("block")
    before = stream.rowsBetween(W.unboundedPreceding, -1)
    html = F.col("type").isin("html", "unclosed", "unexpected")  # a statement by itself
    ends = F.col("outer") & (F.col("text") == ";") | (F.col("type") == "term") | html
    label = F.col("outer") & (F.col("text") == ":") & ~F.col("opens_block")
    piece = F.coalesce(F.sum((ends | (F.col("outer") & F.col("opens_block"))).cast("int")).over(before), F.lit(0)) + F.sum(html.cast("int")).over(stream)
    held = held.withColumn("piece", piece)
    # Pieces follow one another, so what one begins with is the last such mark: rows stay in the order they have.
    first = F.when(F.col("opens_block"), "").when(F.col("type") == "op", F.col("text")).otherwise(F.col("word"))
    held = held.withColumn("begins", F.coalesce(F.lag("piece").over(stream) < F.col("piece"), F.lit(True)))
    held = held.withColumn("head", F.last(F.when(F.col("begins"), first), ignorenulls=True).over(stream.rowsBetween(W.unboundedPreceding, 0)))
    done = ends | (F.col("outer") & F.col("opens_block") & F.col("head").isin(*HEADS)) | (label & F.col("head").isin("case", "default"))
    held = held.withColumn("stmt", F.coalesce(F.sum(done.cast("int")).over(before), F.lit(0)) + F.sum(html.cast("int")).over(stream))
    return held.where("type <> 'term'").select("file_ord", "block", "stmt", "type", "text", "word", "at", *PLACE)


def chained(nodes: DataFrame) -> DataFrame:
    """Else, elseif, catch, finally, and the while of a do, brought to the statement they go on with.

    ``nodes`` are those of statements (root: the first of each).  An else takes
    the nearest if still open, at any depth of statements without braces, and a
    while the nearest do.  That is matching of brackets: ifs open a level, an
    else closes one, and the level before it is its partner's.  What was begun
    with as many ifs open as the partner's level ends there; what no else ends
    goes on to the end of its run, the statements that go on with one another.
    The body of a do is a level of its own.  Sets the field and the ends, and
    adds an error row for each that has nothing to go on with.
    """
    kind, root = F.col("kind"), F.col("root")
    is_kind = lambda *kinds: F.coalesce(kind.isin(*[f"Stmt_{k}" for k in kinds]), F.lit(False))
    order = ("stmt", "local")
    here, before = W.partitionBy("file_ord", "block").orderBy(*order), W.partitionBy("file_ord", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = nodes.withColumn("dos", F.sum(F.when(is_kind("Do"), 1).when(root & is_kind("While"), -1).otherwise(0)).over(here))
    # A while with no do open makes a new minimum, and counts for nothing.
    df = df.withColumns({"least": F.least(F.lit(0), F.coalesce(F.min("dos").over(before), F.lit(0))), "ended": F.max(F.struct(*PLACE[3:])).over(before)})
    df = df.withColumn("of_do", root & is_kind("While") & (F.col("dos") >= F.col("least"))).withColumn("level", F.col("dos") - F.least("least", "dos") - is_kind("Do").cast("int"))
    goes_on = root & (is_kind("Else", "ElseIf", "Catch", "Finally") | F.col("of_do"))
    within_do = F.coalesce(F.col("level") > F.lag(F.when(is_kind("Do"), F.col("level"))).over(here), F.lit(False))
    df = df.withColumn("fresh", (root & ~goes_on) | within_do)
    df = df.withColumn("run", F.sum(F.col("fresh").cast("int")).over(W.partitionBy("file_ord", "block", "level").orderBy(*order)))
    run = W.partitionBy("file_ord", "block", "level", "run").orderBy(*order)
    earlier = run.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({
        "ifs": F.coalesce(F.sum(F.when(is_kind("If"), 1).when(root & is_kind("Else"), -1).otherwise(0)).over(earlier), F.lit(0)),
        "tried": F.last(F.when(is_kind("TryCatch") | (root & is_kind("Finally")), kind), ignorenulls=True).over(earlier),
        "run_end": F.max(F.struct(*PLACE[3:])).over(run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    with_if = root & is_kind("Else", "ElseIf") & (F.col("ifs") > 0)
    met = with_if | (root & is_kind("Catch", "Finally") & (F.coalesce("tried", F.lit("")) == "Stmt_TryCatch")) | F.col("of_do")
    lost = root & is_kind("Else", "ElseIf", "Catch", "Finally") & ~met
    # An else ends what was begun with as many ifs open as there are before it, and itself is begun with one less.
    role = lambda name, key: F.struct(F.lit(name).alias("role"), key.cast("bigint").alias("key"))
    own = role("own", F.col("ifs") - is_kind("Else").cast("int"))
    df = df.withColumn("r", F.explode(F.when(with_if, F.array(own, role("ends", F.col("ifs")))).when(lost, F.array(own, role("lost", F.lit(-1)))).otherwise(F.array(own)))).select("*", "r.*").drop("r")
    later = W.partitionBy("file_ord", "block", "level", "run", "key").orderBy(*order, "role").rowsBetween(1, W.unboundedFollowing)
    df = df.withColumn("upto", F.coalesce(F.first(F.when(F.col("role") == "ends", F.col("ended")), ignorenulls=True).over(later), F.col("run_end"))).where("role <> 'ends'")
    extends = is_kind(*[k.removeprefix("Stmt_") for k in OPEN_ENDED]) & ~F.col("of_do")
    field = F.lit("stmts")
    for k, name in CHAINED.items():
        field = F.when(kind == k, name).otherwise(field)
    is_lost = F.col("role") == "lost"
    word = F.lower(F.regexp_replace(kind, "^Stmt_", ""))
    df = df.withColumns({c: F.when(extends, F.col("upto")[c]).otherwise(F.col(c)) for c in PLACE[3:]} | {
        "field": F.when(met, field).when(goes_on, "stmts").otherwise(F.col("field")), "message": F.when(is_lost, F.concat(F.lit("unexpected '"), word, F.lit("'"))).otherwise(F.col("message")),
        "kind": F.when(~is_lost, kind), "root": root & ~is_lost,
    })
    # A case reaches to the next one of its block.
    case = root & is_kind("Case")
    df = df.withColumn("case", F.sum((F.col("root") & (F.col("kind") == "Stmt_Case")).cast("int")).over(here))
    df = df.withColumn("upto", F.max(F.struct(*PLACE[3:])).over(W.partitionBy("file_ord", "block", "case")))
    df = df.withColumns({c: F.when(case, F.col("upto")[c]).otherwise(F.col(c)) for c in PLACE[3:]})
    return df.drop("dos", "least", "ended", "of_do", "level", "fresh", "run", "ifs", "tried", "run_end", "role", "key", "upto", "case")
