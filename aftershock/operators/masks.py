"""Activity of customers or restaurants as bits: one row per entity and four years.

A row has a word of bits for each phase, once for all orders (``seen_*``) and once for the kept ones
(``kept_*``). Bit ``i`` stands for the ``i``-th month of the row's span, and the months just before
and after the span have a bit as well, so who came back and who left is a shift and an
``and`` within the row: no window, no join, nothing shuffled but counts. New orders are
merged by ``or``, without the old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.functions.calendar import MONTH, month_number
from aftershock.functions.measures import is_kept
from aftershock.specs import PHASES

# Months of a row; with one more on each side they fit the bits of a long.
SPAN = 48
WORDS = [f"{kind}_{phase}" for kind in ("seen", "kept") for phase in PHASES]


def activity_masks(orders: DataFrame, entity: str) -> DataFrame:
    """Rows (entity, span, words) of dated orders; the unknown entity has rows like any other.

    Combines on the map side to a row per entity and span, however many orders there are.
    """
    month = month_number(F.col("month_start_date"))
    own = F.floor(month / SPAN).cast("int")
    place = (month - own * SPAN + 1).cast("int")
    # A month at the edge of its span is also the neighbour of another one.
    at = F.filter(
        F.array(
            F.struct(own.alias("span"), place.alias("place")),
            F.when(place == 1, F.struct((own - 1).alias("span"), F.lit(SPAN + 1).alias("place"))),
            F.when(place == SPAN, F.struct((own + 1).alias("span"), F.lit(0).alias("place"))),
        ),
        lambda x: x.isNotNull(),
    )
    per_month = orders.groupBy(entity, *MONTH).agg(F.max(F.coalesce(is_kept(), F.lit(False))).alias("bought"))
    placed = per_month.select(entity, "phase", "bought", F.inline(at))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))
    words = {}
    for phase in PHASES:
        here = F.col("phase") == phase
        words[f"seen_{phase}"] = F.when(here, bit)
        words[f"kept_{phase}"] = F.when(here & F.col("bought"), bit)
    return _merged(placed.select(entity, "span", *[words[w].alias(w) for w in WORDS]), entity)


def extend_masks(masks: DataFrame, new_orders: DataFrame, entity: str) -> DataFrame:
    """Masks with the activity of further dated orders, late ones included."""
    return _merged(masks.unionByName(activity_masks(new_orders, entity)), entity)


def _merged(rows: DataFrame, entity: str) -> DataFrame:
    nothing = F.lit(0).cast("bigint")
    return rows.groupBy(entity, "span").agg(*[F.coalesce(F.bit_or(w), nothing).alias(w) for w in WORDS])


def months_of(masks: DataFrame, *kept: str, **bits: Column) -> DataFrame:
    """One row per month and phase in which an entity has a bit in one of ``bits``.

    ``bits`` maps names to words by phase, as :func:`kept_bits` and the like give them; the rows have a
    flag under each name, the calendar ``MONTH`` and the columns ``kept``.
    """
    cells = [_cells(phase, {name: by_phase[phase] for name, by_phase in bits.items()}) for phase in PHASES]
    rows = masks.select("span", *kept, F.inline(F.concat(*cells)))
    number = F.col("span") * SPAN + F.col("place") - 1
    # Month 1 of the year 1 is number 13.
    month = F.make_date(F.floor((number - 1) / 12).cast("int"), (F.pmod(number - 1, F.lit(12)) + 1).cast("int"), F.lit(1))
    return rows.select(month.alias(MONTH[0]), MONTH[1], *kept, *bits)


def _cells(phase: str, words: dict[str, Column]) -> Column:
    """The months of a row that have a bit in one of the words, as (place, phase, a flag per word)."""
    any_word = F.lit(0).cast("bigint")
    for word in words.values():
        any_word = any_word.bitwiseOR(word)
    places = F.filter(F.sequence(F.lit(1), F.lit(SPAN)), lambda place: _has(any_word, place))
    return F.transform(
        places,
        lambda place: F.struct(
            place.alias("place"), F.lit(phase).alias("phase"), *[_has(w, place).alias(n) for n, w in words.items()]
        ),
    )


def _has(word: Column, place: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, place.cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def seen_bits() -> dict[str, Column]:
    return {phase: F.col(f"seen_{phase}") for phase in PHASES}


def kept_bits() -> dict[str, Column]:
    return {phase: F.col(f"kept_{phase}") for phase in PHASES}


def returning_bits() -> dict[str, Column]:
    """Months with a kept order after a month with one, whatever that month's phase."""
    words = kept_bits()
    any_phase = words["pre"].bitwiseOR(words["crisis"]).bitwiseOR(words["post"])
    before = F.call_function("shiftleft", any_phase, F.lit(1))
    return {phase: word.bitwiseAND(before) for phase, word in words.items()}


def staying_bits(same_phase: bool = True) -> dict[str, Column]:
    """Months with a kept order before a month with one, of the same phase or of any."""
    words = kept_bits()
    any_phase = words["pre"].bitwiseOR(words["crisis"]).bitwiseOR(words["post"])
    following = {p: F.call_function("shiftrightunsigned", w if same_phase else any_phase, F.lit(1)) for p, w in words.items()}
    return {phase: word.bitwiseAND(following[phase]) for phase, word in words.items()}
