"""Members of Ruby classes: methods with the visibility that holds where they stand, associations, callbacks, validations, scopes.

A file is its lines (file, no, line). A line opens a scope, closes one or neither; running sums over a file give the depth, never
below the file itself. The scope of a line is the last one opened at its depth, and its visibility the last bare `private`,
`protected` or `public` in that scope, so classes within classes begin anew and go on where they were. All of it is windows over
a file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import pascal
from quillon.session import table

# Words that open a scope, associations, callbacks
OPENING = "class|module|def|if|unless|case|while|until|for|begin"
ASSOCIATIONS = "has_many|belongs_to|has_one|has_and_belongs_to_many"
CALLBACKS = (
    "before_save after_save around_save before_create after_create around_create before_update after_update around_update before_destroy after_destroy around_destroy "
    "before_validation after_validation after_commit after_rollback after_create_commit after_update_commit after_destroy_commit after_save_commit before_action after_action "
    "around_action skip_before_action skip_after_action skip_around_action before_filter after_filter around_filter prepend_before_action append_after_action"
).split()
VISIBLE = "private|protected|public"


def _code(line: Column) -> Column:
    """A line without its comment and the blanks about it."""
    return F.regexp_replace(F.regexp_replace(line, r"(^|\s)#(\s.*)?$", ""), r"^\s+|\s+$", "")


def _opens(code: Column) -> Column:
    begins = code.rlike(rf"^({OPENING})\b") | code.rlike(rf"^({VISIBLE}|private_class_method)\s+def\b") | code.rlike(r"\bdo(\s*\|[^|]*\|)?$") | code.rlike(r"=\s*(if|unless|case|begin|while|until)\b")
    whole = code.rlike(r"[\s;]end$") | code.rlike(r"\bdef\s+[\w.?!]+(\([^)]*\))?\s+=\s")
    return (begins & ~whole).cast("int")


def _target(name: Column, kind: Column, rest: Column) -> Column:
    told = F.regexp_extract(rest, r"(?:class_name:|:class_name\s*=>)\s*['\"`]?([\w:]+)", 1)
    one = F.when(name.endswith("ies"), F.concat(F.left(name, F.length(name) - 3), F.lit("y"))).when(name.rlike("(s|x|z)es$"), F.left(name, F.length(name) - 2)).when(name.endswith("s") & ~name.endswith("ss"), F.left(name, F.length(name) - 1)).otherwise(name)
    return F.when(told != "", told).otherwise(pascal(F.when(kind.isin("has_many", "has_and_belongs_to_many"), one).otherwise(name)))


def members(lines: DataFrame) -> DataFrame:
    """(file, no, owner, kind, name, visibility, detail) of what classes hold, and of methods outside any scope (owner null).

    Methods of classes themselves are `self.name`, scopes are `scope:name` and public. detail: the class that an association names
    and its options; the fields of a validation.
    """
    code = _code(F.col("line"))
    closes = F.when(code.rlike(r"^end\b"), F.when(code.rlike(r"\bdo(\s*\|[^|]*\|)?$"), 0).otherwise(1)).otherwise(0)
    rows = lines.select("file", "no", code.alias("code"), F.when(code.rlike(r"^end\b"), 0).otherwise(_opens(code)).alias("up"), closes.alias("down")).filter("code <> ''")
    w = Window.partitionBy("file").orderBy("no")
    rows = rows.withColumn("sum", F.sum(F.col("up") - F.col("down")).over(w)).withColumn("low", F.least(F.lit(0), F.min("sum").over(w)))
    rows = rows.withColumn("depth", F.col("sum") - F.col("low"))
    name = F.regexp_extract("code", r"^class\s+([A-Z][\w:]*)", 1)
    opened = rows.filter("up = 1").select("file", "no", F.col("depth").alias("at"), F.lit("").alias("code"), F.struct(F.col("no").alias("no"), F.nullif(name, F.lit("")).alias("owner")).alias("scope"))
    inside = rows.filter("down = 0").select("file", "no", (F.col("depth") - F.col("up")).alias("at"), "code", F.lit(None).cast("struct<no:bigint,owner:string>").alias("scope"))
    # a line that opens a scope stands before the scope itself, so at one number the line comes first
    level = Window.partitionBy("file", "at").orderBy("no", F.col("scope").isNotNull())
    held = opened.select("file", F.col("no").cast("long").alias("no"), "at", "code", F.struct(F.col("scope.no").cast("long").alias("no"), F.col("scope.owner").alias("owner")).alias("scope")).unionByName(inside.withColumn("no", F.col("no").cast("long")))
    held = held.withColumn("scope_at", F.when(F.col("at") > 0, F.last("scope", True).over(level))).filter("code <> ''")
    held = held.select("file", "no", "at", "code", F.col("scope_at.no").alias("scope_no"), F.col("scope_at.owner").alias("owner"))
    bare = F.nullif(F.regexp_extract("code", rf"^({VISIBLE})(?:\(\))?$", 1), F.lit(""))
    held = held.withColumn("visibility", F.coalesce(F.last(bare, True).over(Window.partitionBy("file", "at", "scope_no").orderBy("no")), F.lit("public")))
    get = lambda pattern, group=1: F.nullif(F.regexp_extract("code", pattern, group), F.lit(""))
    in_class, loose = F.col("owner").isNotNull(), F.col("at") == 0
    own, method = get(r"^def\s+(self\.)", 1), get(r"^def\s+(?:self\.)?([\w]+[?!=]?|[^\s\w(]+)", 1)
    link, linked = get(rf"^({ASSOCIATIONS})\b[\s(]*:\w+"), get(rf"^(?:{ASSOCIATIONS})\b[\s(]*:(\w+)")
    rest = get(rf"^(?:{ASSOCIATIONS})\b[\s(]*:\w+\s*,\s*(.*?)\)?$")
    check = get(r"^(validates_\w+|validates|validate)\b")
    flat = F.regexp_replace(F.regexp_replace("code", r"^\w+[\s(]*", ""), r"\[[^\]]*\]|\{[^}]*\}", "")
    fields = F.array_join(F.regexp_extract_all(flat, F.lit(r"(?:^|,)\s*:(\w+)\b(?!\s*=>)"), F.lit(1)), ", ")
    call = get(r"^(\w+)\b")
    scope = get(r"^scope[\s(]+:(\w+)")
    tell = lambda kind, name, visibility=F.lit(None), detail=F.lit(None): F.struct(F.lit(kind).alias("kind"), name.alias("name"), visibility.cast("string").alias("visibility"), detail.cast("string").alias("detail"))
    found = (
        F.when(method.isNotNull() & in_class, tell("method", F.concat(F.coalesce(own, F.lit("")), method), F.col("visibility")))
        .when(method.isNotNull() & own.isNull() & loose, tell("method", method, F.lit("public")))
        .when(~in_class, F.lit(None))
        .when(link.isNotNull(), tell("association", linked, detail=F.concat_ws(" ", link, _target(linked, link, F.coalesce(rest, F.lit(""))), rest)))
        .when(check.isNotNull(), tell("validation", check, detail=fields))
        .when(call.isin(CALLBACKS), tell("callback", call))
        .when(scope.isNotNull(), tell("method", F.concat(F.lit("scope:"), scope), F.lit("public")))
    )
    return held.withColumn("m", found).filter("m IS NOT NULL").select("file", "no", "owner", "m.*")


# -- registered queries --------------------------------------------------------------------------------------------------

# Lines of code for the query, by the length of a document's line; {} is that length
TEMPLATES = [
    "class A{} < Base", "module M{}", "def m{}", "  def self.n{}(x)", "private", "protected  # from here", "public", "if x > {}", "has_many :companies, dependent: :destroy", "belongs_to :owner{}, class_name: 'User{}'",
    "validates :a, :b{}, inclusion: [:c, :d], if: :on?", "validate :check", "before_save :go{}", "scope :s{}, -> {{ where(a: {}) }}", "end", "end", "end # of it", "items.each do |x|", "private :m{}", "private def p{}",
    "def q{} = 1", "class << self", "has_one(:box{})", "class B{}; end", "y = case {}", "end", "# def no{}", "def ==(other)",
]


def _lines(s, d) -> DataFrame:
    """Documents as files of code, a class with a line of code for each further line of text."""
    n = F.length("line").cast("string")
    code = F.element_at(F.array(*(F.regexp_replace(F.replace(F.replace(F.lit(t), F.lit("{{"), F.lit("<")), F.lit("}}"), F.lit(">")), r"\{\}", n) for t in TEMPLATES)), (F.length("line") % len(TEMPLATES) + 1).cast("int"))
    rows = table(s, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.select("file", "no", F.when(F.col("no") == 0, "class Top < Base").otherwise(code).alias("line"))


QUERIES = {"ruby_members": lambda s, d: members(_lines(s, d))}
SQL: dict[str, str] = {}
