"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame and SQL only.

Base spans follow fixed rules per kind (email, ip, card, phone) and always stay. Beside them,
high-recall generators propose overlapping spans: loose numbers, spelled-out emails,
colon-separated addresses, blocks of digits, phone numbers of a usual shape. Each candidate has format
features (generator, digits, separators, lengths of the first and last group, leading character,
brackets, format check) and context features (the characters around it, the word before it),
all binned.

The trees learn from `LABELLED` rows that SQL writes: personal data in the forms that people use
(`TRUE`) and look-alikes such as dates, versions, order numbers, hexadecimal strings (`FALSE`), each
in a context. They are fitted on three fifths of the rows; a fifth calibrates them (Platt) and sets
per generator the least probability above which a share of PRECISION is personal data; the last
fifth is held out for `quality`. Trees fit on the contingency table of the binned
features exactly as they would on the rows. Model and calibration become one SQL expression, so
that finding spans is one pass over the documents.

A candidate is added if its calibrated probability reaches its generator's threshold and no base
span meets it (a base span covers that place already).

Positions come from SQL too: splitting at a pattern and extracting it give the same matches, so
lengths add up to starts. All patterns run in linear time and without recursion: groups repeat
possessively, and a run that failed from its first character is not tried from its second. Folds
over a text's spans go in blocks of about the root of their number, as appending copies: texts
with many thousands of spans take time by n**1.5 at most.

Defined results: null text is the empty text, without spans; positions count code points, ends
are exclusive; spans of different kinds may overlap; rows with equal or null ids are rows of
their own; an empty table gives an empty result; `redact` keeps every other column, whatever its
name (also own, email, found, spans); `find_personal_data` reads no other column.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.columns import named, packed, unpacked
from larder.session import staged

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # \G: a local part may also start where the match before it ended
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "contains({t}, '@')", "ip": "contains({t}, '.')", "card": "{t} rlike '[0-9]'", "phone": "contains({t}, '+')"}
VALID = {
    "email": "true",
    "ip": r"forall(split({m}, '\\.'), p -> length(trim(LEADING '0' FROM p)) <= 3 and coalesce(try_cast(trim(LEADING '0' FROM p) as int), 0) <= 255)",
    "card": "length(regexp_replace({m}, '[^0-9]', '')) between 16 and 19 and luhn_check(regexp_replace({m}, '[^0-9]', ''))",
    "phone": "length(regexp_replace({m}, '[^0-9]', '')) between 8 and 15",
}
SIZES = {"email": 5, "ip": 7, "card": 16, "phone": 9}  # the fewest characters of a valid match

GENERATORS = {
    "number": r"(?<![0-9])[(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+",
    "spelled": rf"(?<!{LOCAL}){LOCAL}++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20\.\x20|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)++",
    "colons": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+(?![0-9A-Za-z:])",
    "block": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "shaped": r"(?<![0-9+(])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
GENERATOR_GUARDS = {"number": "{t} rlike '[0-9]'", "spelled": r"{t} rlike '@|[\\[(]at[\\])]'", "colons": "contains({t}, ':')", "block": "{t} rlike '[0-9]{{4}}'", "shaped": "{t} rlike '[0-9]{{4}}'"}
KIND_OF = {"spelled": 0, "colons": 1, "block": 2, "shaped": 3}  # "number": a card from 16 digits on, else a phone
HEX = "[0-9A-Fa-f]{1,4}"
# the format check of a generator, over c.m; of the others it is a card's
CHECKS = {
    "spelled": (rf"^{LOCAL}++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\.|\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)++$", "[A-Za-z]{2}$"),
    "colons": (rf"^(?:{HEX}(?::{HEX}){{7}}|(?:{HEX}:)++(?::|(?::{HEX})++:?))$",),
}
TELLING = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|account|reach|write|host|addr|ip)\b"
COUNTING = r"(?i)\b(?:version|build|order|invoice|ref|isbn|issn|serial|id|no|nr|on|dated|date|year|token|hash|score|ratio|lot|batch|page|since|total)[\x20.:#=\"-]*$"
BEFORE = 24  # characters of context
FEATURES = {"generator": 5, "digits": 8, "separators": 5, "first": 4, "last": 4, "lead": 3, "bracket": 2, "checksum": 2, "before": 5, "after": 5, "context": 3}
CELLS = math.prod(FEATURES.values())  # the table's rows are bounded by this product, and by the labelled rows

LABELLED = 15_000  # rows written to learn from, whatever the corpus
PARTS = ("fit", "fit", "fit", "calibrate", "hold out")
ROUNDS, DEPTH, RATE, PRECISION = 40, 4, 0.3, 0.995

# Forms of the labelled rows: # a digit, ~ a hexadecimal digit, ^ a name. The second item says what else holds: "luhn"
# (the digits pass the check; they fail it elsewhere), "told" (only after a telling word), "counted" (only after a counting one).
TRUE = (
    ("(###) ###-####", ""), ("###-###-####", "told"), ("###.###.####", "told"), ("### ### ####", "told"), ("0### #######", "told"), ("0###/#######", "told"), ("0# ## ## ## ##", "told"),
    ("00## ### #######", "told"), ("(0##) #### ####", ""), ("##########", "told"), ("+# (###) ###-####", ""), ("+## (###) ###-####", ""), ("+## ### ### ####", ""),
    ("####.####.####.####", "luhn"), ("####/####/####/####", "luhn"), ("#### #### #### ####", "luhn"), ("####-####-####-####", "luhn"), ("################", "luhn"), ("################", "luhn"),
    ("^ [at] ^ [dot] org", ""), ("^.^(at)^ (dot) ^ (dot) com", ""), ("^ @ ^.com", ""), ("^ @ ^.^.com", ""), ("^## @ ^.^.net", ""), ("^ [at] ^.net", ""), ("^@^ . org", ""),
    ("~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", ""), ("2001:db8::~~~~:~~:~~~~", ""), ("2001:db8:0:~:~:~:~:~", ""), ("fe80::~~~~:~", ""), ("fe80:0:~::", ""),
)
FALSE = (
    ("20##-0#-1# 1#", ""), ("20##-0#-1# 0#", ""), ("19##-19## 20##", ""), ("1#.#.####.#", ""), ("###.###.###", ""), ("# ### ###", ""), ("978-#-##-######-#", ""), ("20##0#1#######", ""),
    ("################", ""), ("#### #### #### ####", ""), ("####-####-####-####", ""), ("####.####.####.####", ""), ("####-######", ""), ("#######", ""), ("########", ""), ("#########", ""),
    ("##########", "counted"), ("###-###-####", "counted"), ("### ### ####", "counted"), ("#### #### ####", ""), ("#.#.#.#.#.#.#", ""), ("######################", ""), ("##/##/#### ##", ""),
    ("####/##/## ##", ""), ("~~b########~~d~", ""), ("a################c", "luhn"), ("e(###) ###-####", ""), ("^ @ #.##", ""), ("^@#.#.#", ""), ("## @ #.##", ""), ("^ @ ^.#", ""),
    ("##:##:##:##", ""), ("#:#:#:#", ""), ("~~:~~:~~:~~:~~:~~", ""), ("1::#::#:#", ""), ("##:##:##:##:##", ""),
)
NAMES = ("ann", "bo", "carla", "dmitri", "elif", "fatou", "gus", "hana", "ines", "jon", "kim", "lena", "mail", "home", "example", "office", "shop", "north")
PLAIN = ("see ", "the ", "und ", "que ", "with ", "", "it was ", "then, ", "and so ", "(", "line\n")
TOLD = ("call ", "phone: ", "tel. ", "contact ", "card ", "mail ", "visa ", "host ", "write to ", "fax ", "reach me: ", "ip ")
COUNTED = ("version ", "order ", "order no. ", "invoice ", "ref ", "isbn ", "build ", "serial ", "id=", "on ", "dated ", 'token = "', "score ", "lot ", "total ")
ENDS = (" and", ". ", ", ", "\n", "", ") ", "!", " said", " 9311664600839016 then", " 2024")


def _sql(text: str) -> str:
    """A text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with `name` for the value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(items: str, kind: str, start: str, state: str, row: str) -> str:
    """SQL: array of `row` over the items x, where a.st is `start` at first and `state` after each item. By
    blocks: an append copies what it appends to."""
    block = f"aggregate(b, named_struct('st', acc.st, 'own', cast(array() as array<{kind}>)), (a, x) -> named_struct('st', {state}, 'own', array_append(a.own, {row})), a -> named_struct('st', a.st, 'out', array_append(acc.out, a.own)))"
    whole = f"aggregate({_blocks('z')}, named_struct('st', {start}, 'out', cast(array() as array<array<{kind}>>)), (acc, b) -> {block}, acc -> flatten(acc.out))"
    return _let(items, "z", f"if(size(z) = 0, cast(array() as array<{kind}>), {whole})")


def _blocks(z: str) -> str:
    """SQL: the array z, which is not empty, in slices of about the root of its size."""
    return _let(f"cast(ceil(sqrt(size({z}))) as int)", "w", f"transform(sequence(0, (size({z}) - 1) div w), i -> slice({z}, cast(i * w + 1 as int), w))")


def _matches(text: str, pattern: str, guard: str) -> str:
    """SQL: array of (s, e, m, b, f): the places of the matches, their text, BEFORE characters before, one after."""
    p, kind = _sql(pattern), "struct<s:int,e:int,m:string,b:string,f:string>"
    around = _let(f"split({text}, {p}, -1)", "q", f"transform(regexp_extract_all({text}, {p}, 0), (m, i) -> named_struct('m', m, 'p', q[i], 'n', left(q[i + 1], 1)))")
    at = "a.st.at + length(x.p)"
    found = _fold(
        around, kind, "named_struct('at', 0, 'last', '')", f"named_struct('at', {at} + length(x.m), 'last', x.m)",
        f"named_struct('s', {at}, 'e', {at} + length(x.m), 'm', x.m, 'b', right(concat(a.st.last, x.p), {BEFORE}), 'f', x.n)",
    )
    return f"if({guard.format(t=text)}, {found}, cast(array() as array<{kind}>))"


def base_spans(text: str, kind: str) -> str:
    """SQL: array of (s, e) of the base spans of a kind."""
    valid = f"length(c.m) >= {SIZES[kind]} and {VALID[kind].format(m='c.m')}"
    return f"transform(filter({_matches(text, PATTERNS[kind], GUARDS[kind])}, c -> {valid}), c -> named_struct('s', c.s, 'e', c.e))"


def _class_of(char: str) -> str:
    """The bin of a neighbouring character."""
    return f"case when {char} is null or {char} = '' then 0 when {char} rlike '[0-9A-Fa-f]' then 1 when {char} rlike '[g-zG-Z_]' then 2 when {char} rlike '[=:\"\\'/#@+-]' then 3 else 4 end"


def _length_bin(digits: str) -> str:
    return f"case when length({digits}) <= 2 then 0 when length({digits}) = 3 then 1 when length({digits}) = 4 then 2 else 3 end"


def _candidate(text: str, name: str, number: int) -> str:
    """SQL: the candidates of a generator with their binned features."""
    only = "regexp_replace(c.m, '[^0-9]', '')"
    digits = f"length({only})"
    check = " and ".join(f"c.m rlike {_sql(p)}" for p in CHECKS[name]) if name in CHECKS else f"{digits} between 16 and 19 and luhn_check({only})"
    features = {
        "generator": str(number),
        "digits": f"case when {digits} <= 7 then 0 when {digits} <= 9 then 1 when {digits} = 10 then 2 when {digits} <= 12 then 3 when {digits} <= 15 then 4 when {digits} = 16 then 5 when {digits} <= 19 then 6 else 7 end",
        "separators": "case when c.m rlike '^[0-9A-Za-z]+$' then 0 when c.m rlike '^[0-9 -]+$' then 1 when c.m rlike '[.]' and c.m rlike '[()]' then 4 when c.m rlike '[()]' then 3 else 2 end",
        "first": _length_bin("regexp_extract(c.m, '[0-9]+', 0)"),
        "last": _length_bin("regexp_extract(c.m, '([0-9]*)[^0-9]*$', 1)"),
        "lead": "case when c.m rlike '^[0(+]' then 0 when c.m rlike '^[12]' then 1 else 2 end",
        "bracket": "cast(startswith(c.m, '(') or contains(c.m, '[') as int)",
        "checksum": f"cast({check} as int)",
        "before": _class_of("right(c.b, 1)"),
        "after": _class_of("c.f"),
        "context": f"case when c.b rlike {_sql(COUNTING)} then 2 when c.b rlike {_sql(TELLING)} then 1 else 0 end",
    }
    fields = ", ".join(f"'{k}', cast({v} as int)" for k, v in features.items())
    return f"transform({_matches(text, GENERATORS[name], GENERATOR_GUARDS[name])}, c -> named_struct('s', c.s, 'e', c.e, 'digit', {digits}, {fields}))"


def _met(base: str, found: str) -> str:
    """SQL: the candidates `found` with `sure`, whether one of the spans `base` meets them. Over all of them by start: from
    the front the furthest end of a base span so far, from the back the nearest start."""
    row = "struct<s:int,e:int,j:int,sure:boolean>"
    both = f"array_sort(concat(transform({base}, x -> named_struct('s', x.s, 'e', x.e, 'j', -1)), transform({found}, (x, i) -> named_struct('s', x.s, 'e', x.e, 'j', i))))"
    ahead = _fold(both, row, "-1", "greatest(a.st, if(x.j < 0, x.e, -1))", "named_struct('s', x.s, 'e', x.e, 'j', x.j, 'sure', a.st > x.s)")
    back = _fold(f"reverse({ahead})", row, "2147483647", "least(a.st, if(x.j < 0, x.s, 2147483647))", "named_struct('s', x.s, 'e', x.e, 'j', x.j, 'sure', x.sure or a.st < x.e)")
    flat = "named_struct(" + ", ".join(f"'{n}', x.{n}" for n in ("s", "e", "digit", *FEATURES)) + ", 'sure', {sure})"
    told = _let(f"array_sort(transform(filter({back}, x -> x.j >= 0), x -> named_struct('j', x.j, 'sure', x.sure)))", "y", f"transform({found}, (x, i) -> {flat.format(sure='y[i].sure')})")
    return f"if(size({base}) = 0 or size({found}) = 0, transform({found}, x -> {flat.format(sure='false')}), {told})"


def _base(form: str = "named_struct('k', {i}, 's', b.s, 'e', b.e)") -> str:
    return "concat(" + ", ".join(f"transform({k}, b -> {form.format(i=i)})" for i, k in enumerate(KINDS)) + ")"


def _spanned(rows: DataFrame) -> DataFrame:
    """rows, which have the text t, with the base spans of each kind and the candidates `found`."""
    rows = rows.withColumns({k: F.expr(base_spans("t", k)) for k in KINDS} | {"raw": F.expr("concat(" + ", ".join(_candidate("t", g, i) for i, g in enumerate(GENERATORS)) + ")")})
    return rows.withColumn("near", F.expr(_base("named_struct('s', b.s, 'e', b.e)"))).withColumn("found", F.expr(_met("near", "raw"))).drop("raw", "near")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """own (a struct of all columns), t (the text), the base spans of each kind as arrays of (s, e), and `found`: the
    candidates with features and `sure`, whether a base span meets one."""
    return _spanned(packed(docs, F.coalesce(named(text), F.lit("")).alias("t")))


def contingency(found: DataFrame, positive: str = "c.sure") -> list[tuple[tuple[int, ...], int, int]]:
    """(feature bins, candidates, positives) of each cell that occurs."""
    one = found.select("*", F.explode("found").alias("c"))
    rows = one.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.sum(F.expr(f"cast({positive} as int)")).alias("k")).collect()
    return sorted((tuple(r[f] for f in FEATURES), r["n"], r["k"]) for r in rows)


def _choice(values: tuple[str, ...], salt: int) -> str:
    """SQL: one of the values, by the row's id."""
    return f"element_at(array({', '.join(map(_sql, values))}), cast(1 + pmod(xxhash64(id, {salt}), {len(values)}) as int))"


def labelled(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """id, part, t (a text around one form), s and e (its place), personal (whether it is personal data)."""
    forms = "array(" + ", ".join(f"named_struct('p', {_sql(p)}, 'how', '{how}', 'personal', {str(kind).lower()})" for kind, all_ in ((True, TRUE), (False, FALSE)) for p, how in all_) + ")"
    count = "length(regexp_replace({p}, '[^#]', ''))"
    drawn = spark.range(rows).selectExpr("id", f"element_at({forms}, cast(1 + pmod(xxhash64(id, 1), {len(TRUE) + len(FALSE)}) as int)) as f", "concat_ws('', transform(sequence(2, 4), k -> lpad(cast(pmod(xxhash64(id, k), 1000000000000) as string), 12, '7'))) as raw")
    sized = drawn.selectExpr("id", "f", f"substring(raw, 1, {count.format(p='f.p')}) as raw", "md5(cast(id as string)) as hex")
    # the last digit makes the check pass, or fail
    last = "transform(sequence(0, 9), k -> concat(left(raw, length(raw) - 1), cast(k as string)))"
    digits = sized.withColumn("digits", F.expr(f"case when f.p like '%#%' then element_at(filter({last}, x -> luhn_check(x) = (f.how = 'luhn')), cast(1 + if(f.how = 'luhn', 0, pmod(xxhash64(id, 5), 9)) as int)) else '' end"))
    char = f"case when ch = '#' then substring(digits, {count.format(p='left(f.p, i + 1)')}, 1) when ch = '~' then substring(hex, 1 + i % 32, 1) when ch = '^' then element_at(array({', '.join(map(_sql, NAMES))}), cast(1 + pmod(xxhash64(id, i + 100), {len(NAMES)}) as int)) else ch end"
    filled = digits.withColumn("span", F.expr(f"array_join(transform(split(f.p, ''), (ch, i) -> {char}), '')"))
    before = f"case when f.how = 'told' then {_choice(TOLD, 6)} when f.how = 'counted' then {_choice(COUNTED, 6)} when pmod(xxhash64(id, 7), 2) = 0 then {_choice(PLAIN, 8)} when f.personal then {_choice(TOLD, 6)} else {_choice(COUNTED, 6)} end"
    part = f"element_at(array({', '.join(map(_sql, PARTS))}), cast(1 + pmod(xxhash64(id, 9), {len(PARTS)}) as int))"
    # a few words first, for the context to reach into; a quarter of the texts begin with the form, or with the word that tells what it is
    bare, needs = "pmod(xxhash64(id, 13), 4) = 0", "f.how in ('told', 'counted')"
    ahead = f"concat(if({bare}, '', concat({_choice(PLAIN, 10)}, {_choice(PLAIN, 11)})), if({bare} and not {needs}, '', {before}))"
    text = filled.selectExpr("id", f"{part} as part", f"{ahead} as b", "span", f"{_choice(ENDS, 12)} as tail", "f.personal as personal")
    return text.selectExpr("id", "part", "concat(b, span, tail) as t", "length(b) as s", "length(b) + length(span) as e", "personal")


_TRUTH = "(personal and abs(c.s - s) <= 1 and abs(c.e - e) <= 1)"  # over a labelled row and its candidate c


@lru_cache(maxsize=1)
def trained(spark: SparkSession) -> Trees:
    """The model of the labelled rows: the same everywhere."""
    rows = staged(_spanned(labelled(spark)), "pii-labelled")
    return Trees(contingency(rows.where("part = 'fit'"), _TRUTH), contingency(rows.where("part = 'calibrate'"), _TRUTH))


def quality(spark: SparkSession, model: Trees) -> DataFrame:
    """generator, candidates, personal, selected and right (selected and personal) over the rows held out."""
    one = staged(_spanned(labelled(spark)), "pii-labelled").where("part = 'hold out'").select("*", F.explode("found").alias("c"))
    names = ", ".join(map(_sql, GENERATORS))
    flags = one.selectExpr(f"element_at(array({names}), c.generator + 1) as generator", f"{_TRUTH} as p", f"{model.selected('c')} as q")
    return flags.groupBy("generator").agg(F.count("*").alias("candidates"), F.count_if("p").alias("personal"), F.count_if("q").alias("selected"), F.count_if(F.col("p") & F.col("q")).alias("right"))


class Trees:
    """Boosted regression trees of the logistic loss on a contingency table."""

    def __init__(self, cells: list[tuple[tuple[int, ...], int, int]], check: list[tuple[tuple[int, ...], int, int]] | None = None):
        """Fitted on `cells`; calibration and thresholds come from `check` (from the cells themselves without it)."""
        self.cells, self.check = cells, cells if check is None else check
        n, k = sum(c[1] for c in cells), sum(c[2] for c in cells)
        self.start = math.log((k + 0.5) / (n - k + 0.5))
        self.trees: list = []
        margins = [self.start] * len(cells)
        for _ in range(ROUNDS if cells else 0):
            p = [1 / (1 + math.exp(-m)) for m in margins]
            g = [c[2] - c[1] * q for c, q in zip(cells, p, strict=True)]
            h = [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)]
            self.trees.append(tree := self._grow(range(len(cells)), g, h, DEPTH))
            margins = [m + self._value(tree, c[0]) for m, c in zip(margins, cells, strict=True)]
        self.slope, self.shift = self._platt([self.margin(c[0]) for c in self.check])
        self.thresholds = self._thresholds()

    def _grow(self, at, g, h, depth):
        gs, hs = sum(g[i] for i in at), sum(h[i] for i in at)
        best = (1e-9, None)
        if depth:
            for f, bins in enumerate(FEATURES.values()):
                gb, hb = [0.0] * bins, [0.0] * bins
                for i in at:
                    b = self.cells[i][0][f]
                    gb[b] += g[i]
                    hb[b] += h[i]
                left_g = left_h = 0.0
                for b in range(bins - 1):
                    left_g, left_h = left_g + gb[b], left_h + hb[b]
                    gain = left_g**2 / (left_h + 1) + (gs - left_g) ** 2 / (hs - left_h + 1) - gs**2 / (hs + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, b))
        if best[1] is None:
            return RATE * gs / (hs + 1)
        f, b = best[1]
        return f, b, self._grow([i for i in at if self.cells[i][0][f] <= b], g, h, depth - 1), self._grow([i for i in at if self.cells[i][0][f] > b], g, h, depth - 1)

    def margin(self, bins) -> float:
        return self.start + sum(self._value(t, bins) for t in self.trees)

    def _value(self, tree, bins) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
        return tree

    def _platt(self, margins) -> tuple[float, float]:
        """Slope and shift of the calibrated log odds, by Newton steps."""
        a, b = 1.0, 0.0
        for _ in range(25):
            gaa, gab, gbb, ga, gb = 1e-3, 0.0, 1e-3, 0.0, 0.0
            for (_, n, k), m in zip(self.check, margins, strict=True):
                q = 1 / (1 + math.exp(-max(-30, min(30, a * m + b))))
                ga, gb, w = ga + (k - n * q) * m, gb + (k - n * q), n * q * (1 - q)
                gaa, gab, gbb = gaa + w * m * m, gab + w * m, gbb + w
            det = gaa * gbb - gab * gab
            a, b = a + 0.5 * (gbb * ga - gab * gb) / det, b + 0.5 * (gaa * gb - gab * ga) / det
        return a, b

    def probability(self, bins) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(bins) + self.shift))))

    def _thresholds(self) -> list[float]:
        """Per generator: the least probability above which the share of positives is PRECISION."""
        out = []
        for g in range(len(GENERATORS)):
            scored = sorted(((self.probability(c[0]), c[1], c[2]) for c in self.check if c[0][0] == g), reverse=True)
            n = k = 0
            level = 2.0  # none
            for p, rows, positives in scored:
                n, k = n + rows, k + positives
                if k >= PRECISION * n:
                    level = p
            out.append(max(level, 0.5))
        return out

    def expression(self, c: str) -> str:
        """SQL: the calibrated probability of candidate c."""

        def case(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree!r}D" if "e" not in repr(tree) else f"cast('{tree!r}' as double)"
            return f"if({c}.{list(FEATURES)[tree[0]]} <= {tree[1]}, {case(tree[2])}, {case(tree[3])})"

        total = " + ".join([f"cast('{self.start!r}' as double)", *map(case, self.trees)])
        return f"1 / (1 + exp(-(cast('{self.slope!r}' as double) * ({total}) + cast('{self.shift!r}' as double))))"

    def selected(self, c: str) -> str:
        level = "case " + " ".join(f"when {c}.generator = {g} then cast('{t!r}' as double)" for g, t in enumerate(self.thresholds)) + " end"
        return f"{self.expression(c)} >= {level}"


def all_spans(found: DataFrame, model: Trees) -> DataFrame:
    """found with `spans`: (k, s, e) of base spans and selected candidates, by kind and start."""
    kind = "case " + " ".join(f"when c.generator = {i} then {KIND_OF[g]}" for i, g in enumerate(GENERATORS) if g in KIND_OF) + " when c.digit >= 16 then 2 else 3 end"
    more = f"transform(filter(found, c -> not c.sure and {model.selected('c')}), c -> named_struct('k', {kind}, 's', c.s, 'e', c.e))"
    return found.withColumn("spans", F.expr(f"array_sort(concat({_base()}, {_united(more)}))"))


def _united(spans: str) -> str:
    """SQL: spans (k, s, e) by kind and start, those of one kind that overlap as one. From the front, each says where its
    union begins and how far it reaches so far; the last of every union stands for it."""
    row = "struct<k:int,s:int,e:int,new:boolean>"
    same = "(x.k = a.st.k and x.s < a.st.e)"
    state = f"named_struct('k', x.k, 's', if({same}, a.st.s, x.s), 'e', if({same}, greatest(a.st.e, x.e), x.e))"
    reached = f"named_struct('k', x.k, 's', if({same}, a.st.s, x.s), 'e', if({same}, greatest(a.st.e, x.e), x.e), 'new', not {same})"
    marked = _fold(f"array_sort({spans})", row, "named_struct('k', -1, 's', 0, 'e', 0)", state, reached)
    return _let(marked, "u", "transform(filter(u, (x, i) -> i = size(u) - 1 or get(u, i + 1).new), x -> named_struct('k', x.k, 's', x.s, 'e', x.e))")


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')"


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row."""
    own = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("t"))
    spans = all_spans(_spanned(own), trained(docs.sparkSession))
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(_joined(_base())).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
    )


def redacted(text: str, spans: str) -> str:
    """SQL: the text with every one of the spans (k, s, e) replaced by its kind in brackets. A block of spans is cut out of
    the text first, as finding a place in it takes time by the place."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    piece = f"if(x.s >= a.at, concat(substring(cut, a.at - acc.at + 1, x.s - a.at), element_at({names}, x.k + 1)), '')"
    inner = f"aggregate(b, named_struct('at', acc.at, 'own', cast(array() as array<string>)), (a, x) -> named_struct('at', greatest(a.at, x.e), 'own', array_append(a.own, {piece})), a -> named_struct('at', a.at, 'out', array_append(acc.out, array_join(a.own, ''))))"
    step = _let(f"substring({text}, acc.at + 1, array_max(transform(b, x -> x.e)) - acc.at)", "cut", inner)
    whole = f"aggregate({_blocks('z')}, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, b) -> {step}, acc -> concat(array_join(acc.out, ''), substring({text}, acc.at + 1)))"
    return _let(f"array_sort(transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k)))", "z", whole)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets, for example [EMAIL];
    spans that overlap become one, under the first one's kind. Null texts stay null, other columns as they are."""
    spans = all_spans(with_spans(docs, text), trained(docs.sparkSession))
    clean = F.when(F.size("spans") > 0, F.expr(redacted("t", "spans"))).otherwise(F.col("own").getField(text))
    return unpacked(spans.withColumn("own", F.col("own").withField("`" + text.replace("`", "``") + "`", clean)))
