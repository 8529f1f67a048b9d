"""Injection-risk signals of a statement, from native string and array expressions.

A statement is first reduced to its *outline*: one blank-separated string in which every literal is
a letter, so that plain regexes can work on it:

    :name  a field, table or function      0  a number, variable, null, true or false
    "  a text literal    '  an empty one    @  a call without arguments or a constant's name
    =  any comparison    !  "not to be judged on its own"    #  a comment

Most signals ask whether the outline holds some word. Tautologies, empty passwords and sensitive
tables depend on the clause. For these the outline is flattened: groups without selects and CASEs are
opened in one pass, and a short loop takes out the innermost of the others, all of one depth at a time. A subselect leaves its select list behind and is
kept as a block of its own; any other group leaves its content. What remains are flat selects whose
table lists and predicates a regex can cut out. All loops in the regexes are possessive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtwatch.functions.fingerprint import DOUBLE_QUOTED, SINGLE_QUOTED
from stmtwatch.sources.rules import CompiledRules, matches

FLAGS = (
    "has_comment", "has_sensitive_table", "has_separator", "has_or", "has_union",
    "has_tautology", "has_empty_password", "has_bruteforce_fn",
)

_WS = r"[ \t-\r\xA0]"
_BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
_LINE_COMMENT = r"(?:--|#)[^\r\n]*+[\r\n]*+"
_BACKTICKED = r"`(?:[^`\\]++|\\[\s\S])*+(?:`|\\?\z)"
_SIGNS = r"[%+\-~!]++[ \t-\r\xA0%+\-~!]*+"

TOKEN = "(?i)" + "|".join([
    _BLOCK_COMMENT,
    _LINE_COMMENT,
    rf"b{_WS}*'[0-9]+'",
    SINGLE_QUOTED,
    DOUBLE_QUOTED,
    _BACKTICKED,
    r"[a-z_][a-z0-9._]*+",
    r"@[a-z0-9.]+",
    r"0x[0-9a-f]+|[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?|\.[0-9]+",
    r"<=>|!=|<>|>=|<=|>>|<<|\|\||&&|[=<>|&^*/;(),.]",
    _SIGNS,
])

# The text up to the first `;` outside literals and comments, then something after it. One ASCII
# character after the `;` is not enough, two bytes are.
_STACKED = (
    r"^(?:[^;'\"`/#%+\-~!]++|" + "|".join([
        SINGLE_QUOTED, DOUBLE_QUOTED, _BACKTICKED, _BLOCK_COMMENT, _LINE_COMMENT, _SIGNS, "/",
    ]) + r")*+;(?:[\s\S]{2}|[^\x00-\x7F])"
)

_COMPARISONS = ("=", "<=>", "!=", "<>", ">=", "<=", ">", "<")
# Characters of a backticked name that mean something in an outline, and their stand-ins.
_SPECIAL = " ;#(),=:\t\n\r"
_STAND_INS = "".join(chr(0xE000 + i) for i in range(len(_SPECIAL)))
_QUALIFIED, _VERSION_CALL, _TABLE_SUBSELECT = "\uE100", "\uE101", "\uE102"
# The parentheses of the subselects that go in a round.
_GOES, _GONE = "\uE103", "\uE104"

# The words which are not names.
_KEYWORDS = (
    "select|update|delete|from|where|having|on|using|join|straight_join|union|group|order|limit|"
    "procedure|set|and|or|xor|not|in|between|like|rlike|regexp|is|as|null|true|false|case|when|"
    "then|else|end|exists|cast|binary|div|(?:left|right|inner|outer|natural|cross)(?! \\()"
)
# Words that a statement may hold without a change to what its flags say.
_NOISE = (
    r"distinctrow|distinct|all|high_priority|sql_small_result|sql_big_result|sql_buffer_result|"
    r"sql_cache|sql_no_cache|sql_calc_found_rows|low_priority|quick|zerofill|latin1_bin|"
    r"latin1_german2_ci|_?latin1|utf8_bin|utf8|_bin|use|ignore|force|for|any|into|by|asc|desc|"
    r"with rollup|collate \S+"
)
# Names of password columns.
_PASSWORD_FIELDS = ("pwd", "pass", "password")

_PLAIN = r"[^ ()]+"
_CONSTANT = "[0\"'@]"
_OPERAND = rf"(?: :\S+| {_CONSTANT}| \)| end)"


def _word(words: str) -> str:
    """A whole word of the outline, with the blank in front of it."""
    return rf" (?:{words})(?= )"


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _run(stop: str, token: str = r"\S+") -> str:
    """Tokens up to a stop word."""
    return rf"(?: (?!(?:{stop}) ){token})*+"


def _replace(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, "(?i)" + pattern, replacement)
    return text


def tokens(query: Column) -> Column:
    """All tokens of a statement, comments included, in order."""
    return F.regexp_extract_all(query, F.lit(TOKEN), F.lit(0))


def outline(toks: Column) -> Column:
    """The tokens as one string, with letters for literals and `#` for comments."""

    def letter(token: Column) -> Column:
        first = F.substring(token, 1, 1)
        name = F.translate(F.regexp_replace(token, r"^`|(?<=[\s\S])`\z", ""), _SPECIAL, _STAND_INS)
        # The most frequent tokens come first: words, then punctuation.
        return (
            F.when(
                first.between("a", "z") | first.between("A", "Z") | (first == "_"),
                F.when(token.endswith("'"), "0").otherwise(token),
            )
            .when(token.isin("(", ")", ",", ".", "*", ";"), token)
            .when(token.isin(*_COMPARISONS), "=")
            .when(first.between("0", "9") | (first == "@"), "0")
            .when(first.isin("'", '"'), F.when(token.isin("''", '""', "'", '"'), "'").otherwise('"'))
            .when((first == "#") | token.startswith("/*") | token.startswith("--"), "#")
            .when(first == "`", F.concat(F.lit(":"), name))
            .when(token == "||", "or")
            .when(token == "&&", "and")
            .when(first == ".", "0")
            .otherwise("+")
        )

    return F.concat(F.lit(" "), F.array_join(F.transform(toks, letter), " "), F.lit(" "))


# Units of a chain of predicates: up to 24 words or groups that hold no group.
_GROUP = r" \((?: [^ ()]+)*+ \)"


def _chain(word: str, ends: str) -> tuple[str, str]:
    """Of equal predicates joined by one word the first and the last stay."""
    unit = rf"((?: (?!(?i:{ends}) )[^ ()]+|{_GROUP}){{1,24}}+)"
    starts = r"( (?i:where|having|on|or|and|xor|\())"
    return rf"(?-i){starts}{unit} (?i:{word})(?:\2 (?i:{word})(?=\2 ))++", f"$1$2 {word}"


def shape(counted: Column) -> Column:
    """What the flags of a statement depend on, but for `has_separator`: the part of the outline that
    counts, without what repeats. The first and the last of a list stay, as the words around it may
    belong to them.

    Of a list of constants the first stays, and the last of each kind; of adjacent equal tuples and
    of adjacent equal predicates of an OR or AND chain two stay. So lists, tuples and chains of any
    length share a shape. Which fields, constants and comparisons there are does not change.
    """
    return _replace(
        F.concat(counted, F.lit(" ")),
        (r" ([0\"']) ,(?: \1 ,(?= \1 ))++", " $1 ,"),
        (r"(?<= [0\"'] ,) ([0\"']) ,(?=(?: [0\"'] ,)*? \1 )", ""),
        (rf"(?-i)({_GROUP}) ,(?:\1 ,(?=\1 ))++", "$1 ,"),
        _chain("or", "or|xor"),
        _chain("and", "and|or|xor"),
    )


# A number that stands alone: no word, other number or literal begins or goes on with it.
_LONE_NUMBER = r"(?<=[ ,(=<>+\-*/])[0-9]++(?:\.[0-9]++)?+(?![0-9A-Za-z_.])"
_TEXT = "(?:(')[^']++'|(\")[^\"]++\")"
_BIT_LITERAL = rf"[bB]{_WS}*+'"


def skeleton(query: Column) -> Column:
    """A statement whose lone numbers are all 1 and whose text literals are all `x`. It has the same
    pattern and the same flags, and takes a fraction of their time to find.

    Which digits a number, a literal or a comment has is of no account to either. A name in backticks
    is, so statements with one stay as they are. Text literals stay where it takes more than a look to
    tell where they end, or whether they are empty or a number.
    """
    def has(*marks: str) -> Column:
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(query, F.lit(mark))
        return found

    plain = has("'", '"') & ~has("\\", "--", "#", "/*", "''", '""') & ~query.rlike(_BIT_LITERAL)
    unquoted = F.when(plain, F.regexp_replace(query, _TEXT, "$1$2x$1$2")).otherwise(query)
    return F.when(has("`"), query).otherwise(F.regexp_replace(unquoted, _LONE_NUMBER, "1"))


def verb(outlined: Column) -> Column:
    return F.lower(F.regexp_extract(outlined, r"^(?: #)*+ ([^# ]\S*)", 1))


def window(outlined: Column, first_word: Column) -> Column:
    """The part of the outline that counts; flags raised by what follows it are not looked at.

    A select from a table, an update or a delete counts up to its first `;` and the word that
    follows; an insert counts three words, a show two, anything else one. Comments in front of the last counted word
    count too.
    """
    def words(n: int) -> Column:
        return F.regexp_extract(outlined, rf"^((?:(?: #)*+ [^# ]\S*){{{n}}}|.*)", 1)

    # A select without FROM ends at its `;` itself.
    complete = r"(?=[^;]* (?:from|update|delete) )[^;]*+;(?: #)*+(?: [^# ]\S*)?"
    to_separator = F.regexp_extract(outlined, rf"(?i)^({complete}|[^;]*+;?)", 1)
    return (
        F.when(first_word.isin("select", "update", "delete"), to_separator)
        .when(first_word == "insert", words(3))
        .when(first_word == "show", words(2))
        .otherwise(words(1))
    )


def has_comment(counted: Column) -> Column:
    return F.contains(counted, F.lit("#"))


def has_separator(query: Column, counted: Column) -> Column:
    return F.contains(counted, F.lit(";")) & query.rlike(_STACKED)


def has_or(counted: Column) -> Column:
    return counted.rlike(r"(?i) or(?: |$)")


def has_union(counted: Column) -> Column:
    return counted.rlike(r"(?i) union(?: |$)")


def _has_word(text: Column, words: str) -> Column:
    return text.rlike("(?i)" + _word(words))


def statement(outlined: Column, first_word: Column) -> Column:
    """The outline of the first select, update or delete of the text, without comments and words
    of no weight; empty for other statements, of which too few words count."""
    unusual = _has_word(outlined, rf"#|;|version|{_NOISE}")
    cut = _replace(
        outlined,
        (r" #(?= )", ""),
        (r"(?s) ;.*", " "),
        (r" version \( \)(?= )", f" :version{_VERSION_CALL}"),
        (_word(_NOISE), ""),
    )
    whole = F.when(unusual, cut).otherwise(outlined)
    return F.when(first_word.isin("select", "update", "delete"), whole).otherwise("")


def named(stated: Column) -> Column:
    """The outline with its names marked."""
    return _replace(stated, (rf"(?<= )(?!(?:{_KEYWORDS}) )([a-z_])(?=\S* )", ":$1"))


def has_bruteforce_fn(names: Column, dialect: Column, rules: CompiledRules) -> Column:
    calls = F.when(
        F.contains(names, F.lit("(")), F.regexp_extract_all(names, F.lit(r" :(\S+)(?= \()"), F.lit(1))
    )
    return F.exists(calls, lambda name: matches(rules, "bruteforce functions", dialect, name))


def starred_tables(names: Column) -> Column:
    """The `t` of every `t.*`."""
    starred = F.regexp_extract_all(names, F.lit(r" :(\S+?)(?:\.| \.) \*(?= )"), F.lit(1))
    return F.when(F.contains(names, F.lit(". *")), starred).otherwise(_no_names())


def compared_alike(names: Column) -> Column:
    """The named outline with one sign for all comparisons, IN included."""
    return _replace(
        names, (r" (?:not )?(?:=|(?::sounds )?like|rlike|regexp|is not|is|in)(?= )", " =")
    )


def simplified(text: Column) -> Column:
    """Without the less frequent words: constants by name, qualifiers, AS, EXISTS, kinds of join."""
    words = r"null|true|false|\.|not|as|exists|cast|binary|left|right|inner|outer|natural|cross"
    plain = _replace(
        text,
        (_word("null|true|false"), " 0"),
        (r" (:\S+) \. :(?=\S)", f" $1{_QUALIFIED}"),
        (_word("not"), ""),
        (r" as [^ ()]+(?: \( [^()]*\))?(?= )", ""),
        (_word("exists|cast|binary"), " !"),
        (_word("left|right|inner|outer|natural|cross"), ""),
    )
    return F.when(_has_word(text, words), plain).otherwise(text)


def reduced(text: Column) -> Column:
    """Without function names, aliases and repeated constants in lists."""
    called = _replace(text, (r" :\S+ \( (?:\* )?\)(?= )", " @"), (r" :\S+(?= \( )", ""))
    unaliased = _replace(
        F.when(F.contains(text, F.lit("(")), called).otherwise(text),
        (rf"({_OPERAND}) (?::\S+|[\"'])(?= )", "$1"),
        (rf" ({_CONSTANT})(?: , \1(?= ))++", " $1"),
    )
    return unaliased


def with_constants(text: Column, dialect: Column, rules: CompiledRules) -> Column:
    """Names that stand for constants in the row's dialect count as such."""
    replaced = F.when(F.lit(False), text)
    for name in sorted({d for d, category in rules if category == "true constants"}):
        listed = "|".join(r.removeprefix("^").removesuffix("$") for r in rules[(name, "true constants")])
        replaced = replaced.when(dialect == name, _replace(text, (rf" :(?:{listed})(?= )", " @")))
    return F.coalesce(replaced, text)


# A CASE without parentheses and other CASEs inside.
_CASE = " case" + _run("case|end", _PLAIN) + r" end(?: case)?(?= )"
# A subselect without parentheses and CASEs inside.
_SUBSELECT = r" \( (select" + _run("case", _PLAIN) + r") \)(?= )"
_LIST_END = "from|where|group|having|order|limit|procedure|union"
_INNER_CLAUSE = "from|order|group|limit"


def _tidied(text: Column) -> Column:
    """Drop the commas inside parentheses, as far as they are not in a table list, and the clause
    words among function arguments."""
    return _replace(
        text,
        (rf"( \((?! select ){_run(_INNER_CLAUSE, _PLAIN)}) (?:{_INNER_CLAUSE})(?= )", "$1"),
        (r"((?: \(|(?!^)\G)(?: (?!from )[^ (),]+)*+) ,(?= )", "$1"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column) -> Column:
    """Running sums of an array, in as many rounds as its size has binary digits: after round k each
    entry holds the sum of the last 2^k."""
    powers = F.array(*[F.lit(1 << k) for k in range(31)])

    def doubled(sums: Column, r: Column) -> Column:
        return F.transform(sums, lambda n, i: n + F.coalesce(F.get(sums, i - r), F.lit(0)))

    return _let(numbers, lambda given: F.aggregate(
        F.filter(powers, lambda r: r < F.size(given)), given, doubled
    ))


def _plain_opened(text: Column) -> Column:
    """Without the parentheses of plain groups in plain groups, however deep and however many.

    A group is plain if neither it nor any group in it holds a select, a CASE or a clause word: the
    rounds of `_looped` would only take its parentheses out, one depth at a time. Here the depth of each
    parenthesis is a running sum. Sorted by depth and place, the two of a group are neighbours; the
    group is plain if the running count of the words that matter is the same at both.
    """
    def step(piece: Column) -> Column:
        return F.when(piece.startswith("("), 1).when(piece.startswith(")"), -1).otherwise(0)

    def matters(piece: Column) -> Column:
        return F.when(piece.rlike(rf"(?i) (?:select|case|{_INNER_CLAUSE}) "), 1).otherwise(0)

    def in_order(pieces: Column, depths: Column, words: Column) -> Column:
        """(depth, place, step, words before) of all parentheses, by depth and place."""
        places = F.sequence(F.lit(1), F.size(pieces) - 1)
        return F.array_sort(F.transform(places, lambda k: F.struct(
            (F.get(depths, k) + F.when(F.get(pieces, k).startswith(")"), 1).otherwise(0)).alias("depth"),
            k.alias("place"),
            step(F.get(pieces, k)).alias("step"),
            F.get(words, k - 1).alias("words"),
        )))

    def paired(opening: Column, closing: Column) -> Column:
        same = (opening.depth == closing.depth) & (opening.words == closing.words)
        return F.coalesce((opening.step == 1) & (closing.step == -1) & same, F.lit(False))

    def plain_steps(ordered: Column) -> Column:
        """1 and -1 at the parentheses of plain groups, 0 at others, by place."""
        marked = F.transform(ordered, lambda o, t: F.struct(
            o.place.alias("place"),
            F.when(paired(o, F.get(ordered, t + 1)), 1)
            .when((t > 0) & paired(F.get(ordered, t - 1), o), -1).otherwise(0).alias("plain"),
        ))
        return F.transform(F.array_sort(marked), lambda m: m.plain)

    def without(pieces: Column, plain: Column, around: Column) -> Column:
        """The text without the parentheses that have a plain group around them."""
        def kept(piece: Column, i: Column) -> Column:
            inner = F.get(around, i - 1) > F.greatest(F.get(plain, i - 1), F.lit(0))
            gone = (i > 0) & (F.get(plain, i - 1) != 0) & inner
            return F.when(gone, F.substring(piece, F.lit(3), F.length(piece))).otherwise(piece)

        return F.array_join(F.transform(pieces, kept), "")

    # Each piece is a parenthesis and what follows it; the first one is what precedes them all.
    pieces = F.regexp_extract_all(text, F.lit(r"^[^()]++|[()][^()]*+"), F.lit(0))
    opened = _let(pieces, lambda pieces: _let(
        _let(_running(F.transform(pieces, step)), lambda depths: _let(
            _running(F.transform(pieces, lambda p: matters(F.concat(F.lit(" "), p)))),
            lambda words: _let(in_order(pieces, depths, words), plain_steps),
        )),
        lambda plain: _let(_running(plain), lambda around: without(pieces, plain, around)),
    ))
    return F.when(text.rlike(r"(?:\([^(]*+){16}"), opened).otherwise(text)


def _undoubled(text: Column) -> Column:
    """Parentheses in parentheses in parentheses: the inner and the outer ones say it all.

    The text is cut behind each run of closing parentheses; a piece then holds one innermost group,
    and as many pairs around it as the shorter of its two runs has.
    """
    def fewer(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"\A.* \(", 0)  # up to the last opening one
        tail = F.substring(piece, F.length(head) + 1, F.length(piece))
        opening = F.length(F.regexp_extract(head, r"(?<! \()(?: \()++\z", 0))
        closing = F.length(F.regexp_extract(tail, r"(?<! \))((?: \))++) ?\z", 1))
        spare = F.greatest(F.least(opening, closing) - 4, F.lit(0))
        within = F.length(F.rtrim(tail)) - spare
        fewer = F.concat(
            F.substring(piece, F.lit(1), F.length(head) - spare),
            F.substring(tail, F.lit(1), within),
            F.substring(tail, within + spare + 1, F.length(tail)),
        )
        return F.when(spare > 0, fewer).otherwise(piece)

    pieces = F.split(text, r"(?<= \))(?= (?!\)))")
    return F.when(
        F.contains(text, F.lit(" ( ( (")), F.array_join(F.transform(pieces, fewer), "")
    ).otherwise(text)


def _unwrapped(text: Column) -> Column:
    """Take out the innermost subselects and other groups. The subselects are marked beforehand, so
    that one which becomes innermost by this is left for the next round, which keeps it as a block."""
    inside = rf"[^ (){_GOES}{_GONE}]+"
    return _replace(
        text,
        (_SUBSELECT, f" {_GOES} $1 {_GONE}"),
        (
            rf"( (?:from|join|straight_join|,)) {_GOES} select{_run('case', inside)} {_GONE}(?= )",
            f"$1 :{_TABLE_SUBSELECT}",
        ),
        (
            rf" {_GOES} select({_run(_LIST_END + '|case', inside)})"
            rf"(?: (?:{_LIST_END}){_run('case', inside)})? {_GONE}(?= )",
            "$1",
        ),
        (rf" \(({_run('case|select|' + _INNER_CLAUSE, _PLAIN)}) \)(?= )", "$1"),
    )


def flattened(text: Column) -> Column:
    """`struct<selects, cases>`: all selects of the statement as flat text, and its CASEs.

    Plain groups of any depth are opened in one pass, then parentheses around parentheses; selects,
    CASEs and what holds them take one round per depth.
    """
    return _let(_plain_opened(text), lambda opened: _let(_undoubled(opened), _looped))


def _looped(text: Column) -> Column:
    """The same, by rounds.

    Each round takes out one depth of nesting, so there are at most as many rounds as words that open
    or close, whichever are fewer, and as clause words. The first round that finds nothing to do closes
    the state; later ones return it as it is. Rounds come in dozens, as each copies its state.
    """
    def count(words: str) -> Column:
        return F.regexp_count(text, F.lit(rf"(?i) (?:{words})(?= )"))

    rounds = F.least(count(r"\(|case"), count(r"\)|end")) + count(_INNER_CLAUSE)
    dozens = F.ceil(rounds / 12).cast("int")
    nothing = _no_names()

    def state_of(text: Column, before: Column, selects: Column, cases: Column, is_open: bool) -> Column:
        return F.struct(
            text.alias("text"), before.alias("before"), selects.alias("selects"),
            cases.alias("cases"), F.lit(is_open).alias("open"),
        )

    def unnest(state: Column, _: Column) -> Column:
        settled = (state.text == state.before) | ~state.text.rlike(r"(?i) (?:\(|case) ")
        cases = F.regexp_extract_all(state.text, F.lit("(?i)" + _CASE), F.lit(0))
        # A subselect whose CASEs go in this round goes in it, too.
        uncased = lambda text: state_of(
            _tidied(_unwrapped(text)),
            state.text,
            F.concat(state.selects, F.regexp_extract_all(text, F.lit("(?i)" + _SUBSELECT), F.lit(1))),
            F.concat(state.cases, cases),
            True,
        )
        return (
            F.when(~state.open, state)
            .when(settled, state_of(state.text, state.text, state.selects, state.cases, False))
            .otherwise(_let(_replace(state.text, (_CASE, " ! :case")), uncased))
        )

    def finish(state: Column) -> Column:
        selects = F.array_join(F.concat(state.selects, F.array(state.text)), " ; ")
        return F.struct(
            F.concat(F.lit(" "), selects, F.lit(" ")).alias("selects"), state.cases.alias("cases")
        )

    def dozen(state: Column, _: Column) -> Column:
        size = F.least(rounds, F.lit(12))
        return F.when(~state.open, state).otherwise(
            F.aggregate(F.array_repeat(F.lit(0), size), state, unnest)
        )

    start = state_of(_tidied(text), F.lit(""), nothing, nothing, True)
    return F.aggregate(F.array_repeat(F.lit(0), dozens), start, dozen, finish)


_TABLES_END = "where|having|group|order|limit|procedure|set|union|select|from|;"
_TABLE_LIST = "(?i) (?:from|update|delete)" + _run(_TABLES_END)
_PREDICATE_END = (
    "where|having|on|from|join|straight_join|group|order|limit|procedure|set|union|using|select|;|,"
)
_PREDICATES = f"(?i) (?:where|having|on)({_run(_PREDICATE_END)})"


def tables(selects: Column) -> Column:
    """The names in the table lists of all selects, also those of an update or delete."""
    lists = F.array_join(F.regexp_extract_all(selects, F.lit(_TABLE_LIST), F.lit(0)), "")
    name = r"(?i) (?:from|update|delete|join|straight_join|,) :(\S+)"
    return F.regexp_extract_all(lists, F.lit(name), F.lit(1))


def has_sensitive_table(names: Column, dialect: Column, rules: CompiledRules) -> Column:
    return F.exists(names, lambda name: matches(rules, "sensitive tables", dialect, name))


def comparisons(selects: Column, cases: Column) -> Column:
    """Every predicate of WHERE, HAVING and ON, and each CASE operand against its WHENs and ELSE,
    as `array<struct<text, fields, constant>>`: one entry per side of its comparisons."""
    predicates = F.array_join(F.regexp_extract_all(selects, F.lit(_PREDICATES), F.lit(1)), " or")
    bounds = (
        rf"((?:^| and| or| xor)(?= ))({_run('and|or|xor|between|=')})(?: not)? between"
        rf"({_run('and|or|xor')}) and(?= )"
    )
    single = F.split(_replace(predicates, (bounds, "$1$2 =$3 or$2 =")), r"(?i) (?:and|or|xor)(?= )")

    operand = r"^ case((?: (?!when )\S+)++) when"
    with_operand = F.transform(
        F.filter(cases, lambda c: c.rlike("(?i)" + operand)),
        lambda c: _replace(F.translate(c, "=", "+"), (" then" + _run("when|else|end"), "")),
    )
    whens = F.transform(
        with_operand, lambda c: _replace(c, (rf"{operand}({_run('else|end')}).*$", "$1 =$2"))
    )
    elses = F.transform(
        F.filter(with_operand, lambda c: c.rlike("(?i) else ")),
        lambda c: _replace(c, (rf"{operand}.* else({_run('end')}).*$", "$1 =$2")),
    )

    def side(text: Column) -> Column:
        names = F.regexp_extract_all(text, F.lit(rf" :(?:\S*{_QUALIFIED})?(\S+)"), F.lit(1))
        return F.struct(
            text.alias("text"),
            F.array_distinct(names).alias("fields"),
            text.rlike(rf" {_CONSTANT}(?: |$)").alias("constant"),
        )

    every = F.concat(single, whens, elses)
    return F.transform(every, lambda p: F.transform(F.split(p, r" =(?= |$)"), side))


def has_tautology(compared: Column) -> Column:
    """A predicate that is a constant, compares things that are always alike, or chains."""

    def always(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        bare = left.constant & (F.size(left.fields) == 0) & ~F.contains(left.text, F.lit("!"))
        same_fields = (F.size(left.fields) == F.size(right.fields)) & (
            F.size(F.array_except(left.fields, right.fields)) == 0
        )
        equal = same_fields & ((F.size(left.fields) == 0) | (left.constant == right.constant))
        written = (F.trim(left.text) != "") & (F.trim(right.text) != "")
        return F.when(F.size(sides) == 1, bare).when(F.size(sides) == 2, equal & written).otherwise(True)

    return F.exists(compared, always)


def has_empty_password(compared: Column) -> Column:
    """One password column against nothing but empty text."""

    def empty(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        return (
            (F.size(sides) == 2)
            & left.text.rlike("^[ +]*:")
            & (F.size(left.fields) == 1)
            & F.lower(F.get(left.fields, F.lit(0))).isin(*_PASSWORD_FIELDS)
            & right.text.rlike(r"^[ +]*'(?: ['0+*])*$")
        )

    return F.exists(compared, empty)
