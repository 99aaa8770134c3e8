"""Typed annotations of questions, as column expressions.

``read`` takes a question apart once, into its words and its blank-separated parts; every
annotator works on that. One dictionary gives each word and phrase the classes it belongs to,
as bits: a question's words are looked up once and their bits combined. A rule asks for bits,
wherever the words stand, for one class behind another, or for what stands behind a label word. Nothing is a Python UDF, so that a table of
questions is annotated in one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from ..schema import FORMULAS
from .addresses import resolve_state, title_case

# Words and phrases by class, in lower case.
STATUSES = {
    "Quoted": ("quoted", "quotes", "quote"), "Cancelled": ("cancelled", "canceled"), "Confirmed": ("confirmed", "confirmations", "confirmation"),
    "Dispatched": ("dispatched",), "Delivered": ("delivered",), "Invoiced": ("invoiced",),
}
STATES_OF_ORDER = ("quoted", "cancelled", "canceled", "confirmed", "dispatched", "delivered", "invoiced")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
BEST = ("best", "top", "biggest", "largest", "highest", "most", "maximum", "max", "premium")
WORST = ("worst", "lowest", "low", "least", "fewest", "smallest", "minimum", "min", "bottom", "poorest", "weakest")
LAST = ("last", "past", "previous")
PICKUP = ("pickup", "pick up")
DELIVERY = ("delivery", "deliver", "drop")
MONEY = ("revenue", "freight", "amount", "sales", "money", "value")
CANADA = ("canada", "canadian")
AMERICA = ("united states", "usa", "america", "american", "u s a", "in us", "in the us")
ZIP = ("pin", "pincode", "zip", "zipcode", "postal")
CUSTOMER = ("customer", "customers", "client", "clients")
ORDER = ("order", "orders")
COUNTING = ("how many", "count")
ADDING = ("total", "sum", "average", "avg")
SHARES = ("summary", "breakdown", "break down", "distribution")
LISTING = ("list", "show", "display", "find", "search", "filter")
ASKING = ("give", "get", "show", "find", "lookup", "look up", "detail", "details", "info", "information", "fetch", "pull", "order number", "ordernumber")
PLACE = ("location", "warehouse", "facility")
REGION = ("state", "province", "city", "town", "address", "street")
GREETINGS = (
    "hi", "hii", "hiii", "hello", "hey", "heyya", "yo", "hola", "namaste", "good morning", "good afternoon", "good evening", "sup", "hiya",
    "thanks", "thank you", "thx", "ty", "ok", "okay", "cool", "great", "nice",
)
FOLLOW_UP = ("that", "this", "same", "it", "its", "uska", "uski", "uske", "wo", "woh", "previous", "again")
OF_AN_ORDER = ("status", "tax", "freight", "detail", "details", "info", "amount", "customer", "delivery", "pickup", "distance", "location")
SENDER = ("origin", "shipper")
RECEIVER = ("consignee", "destination")
CUSTOMERS = ("customer", "customers")
HOW_MANY = ("how many",)
DELIVERED = ("delivered",)
SORT_LOW = ("lowest", "smallest", "least", "cheapest", "min")
SORT_LOW_BY = ("amount", "freight", "tax", "distance")
SORT_TOP = ("best", "highest", "max", "top", "largest", "most")
SORT_TOP_BY = ("amount", "freight", "revenue", "tax", "distance")
EVERY = ("all", "every")
WIDE = ("total", "sum", "all")
OVERALL = ("total", "sum", "aggregate", "overall")
TOTAL = ("total",)
GET = ("get",)
STATUS_WORDS = ("status", "statuses")
STATUS_SHARES = ("summary", "total", "breakdown")
IN_COUNTRY = ("number of", "in canada", "in us", "in usa", "in the us", "in united")
ON_A_DAY = ("kitne", "kitna", "number of", "ordered", "diya", "created", "total", "on", "for", "dated", "date")
PLACE_SHARES = ("breakdown", "break down", "summary")
NO_PLACE_COUNT = ("customer", "best", "worst")
BY_STATE = ("state wise", "statewise", "by state", "orders per state", "order per state")
STATES = ("state", "states")
CITY = ("city",)
BY_CITY = ("city wise", "citywise", "by city", "orders per city", "order per city")
CITIES = ("cities",)
IN_A_PERIOD = ("kitne", "kitna", "created", "quoted", "confirmed", "confirmation", "status")
TRIP = ("trip", "trips", "tripno")
DISTANCE = ("distance",)
FLEET = ("how many", "all", "fleet")
CALCULATING = ("aggregate", "formula", "calculate", "calculation", "net after")
WHICH = ("which", "all")
ORDERSTATUS = ("orderstatus",)
COMPARE = ("compare",)
NO_LOOKUP = ("all", "list", "filter", "compare", "vs")
DETAILS = ("detail", "details", "give", "get", "show")
MEASURED = ("order", "amount", "freight", "tax", "distance", "revenue")
RANKED = ("best", "highest", "top", "largest", "most", "lowest", "smallest")
ONE_CUSTOMER = ("customer",)
RECENT = ("recent", "latest")
MOVED = ("pickup", "delivery", "drop")
NO_PLACES = ("customer count", "best", "worst", "low")
DATED = ("on", "dated", "date", "pickup", "delivery")
ASKED_AGAIN = ("status", "tax", "freight")
OF_THAT_ORDER = ("status", "tax", "freight", "detail", "amount", "customer", "delivery")
COMPARING = ("compare", "difference", "vs", "versus")
#: Two-letter words that are no state, though they are spelled like a code.
NO_STATES = ("in", "or", "me", "ok", "hi", "oh", "id", "us", "la", "de", "ma", "pa")
# Other names of the formulas.
ALIASES = {
    "order_count": ("how many orders", "order count", "number of orders", "total orders", "count of orders"),
    "total_taxes": ("total tax", "total taxes", "sum of tax", "sum of taxes", "tax total", "all taxes"),
    "total_tax_amount": ("total tax amount", "sum totaltaxamount"),
    "total_freight": ("total freight", "sum freight", "freight total", "all freight"),
    "total_revenue": ("total revenue", "revenue", "gross revenue", "total gross freight", "grosstotalfreight", "gross total freight"),
    "total_fuel_charges": ("total fuel", "fuel charges", "sum fuel", "total fuel charges"),
    "total_other_charges": ("total other charges", "other charges", "sum other charges"),
    "total_offered_amount": ("total offered", "offered amount", "sum offered"),
    "total_pretax_amount": ("total pretax", "pre tax total", "pretax amount"),
    "total_distance": ("total distance", "sum distance", "all miles", "total miles"),
    "avg_taxes": ("average tax", "avg tax", "average taxes", "mean tax"),
    "avg_freight": ("average freight", "avg freight", "mean freight"),
    "avg_revenue": ("average revenue", "avg revenue", "mean revenue"),
    "net_after_tax_estimate": ("net after tax", "revenue after tax", "freight minus tax", "net revenue"),
    "freight_plus_fuel": ("freight plus fuel", "freight and fuel", "freight + fuel"),
}


#: All classes that rules ask for; each has one bit.
CLASSES = (
    *STATUSES.values(),
    PICKUP, DELIVERY, BEST, WORST, MONEY, CANADA, AMERICA, ZIP, CUSTOMER, ORDER, COUNTING, ADDING, SHARES, LISTING,
    ASKING, PLACE, REGION, FOLLOW_UP, OF_AN_ORDER, STATES_OF_ORDER, SENDER, RECEIVER, CUSTOMERS, HOW_MANY, DELIVERED,
    SORT_LOW, SORT_LOW_BY, SORT_TOP, SORT_TOP_BY, EVERY, WIDE, OVERALL, TOTAL, GET, STATUS_WORDS, STATUS_SHARES,
    IN_COUNTRY, ON_A_DAY, PLACE_SHARES, NO_PLACE_COUNT, BY_STATE, STATES, CITY, BY_CITY, CITIES, IN_A_PERIOD, TRIP,
    DISTANCE, FLEET, CALCULATING, WHICH, ORDERSTATUS, COMPARE, NO_LOOKUP, DETAILS, MEASURED, RANKED, ONE_CUSTOMER,
    RECENT, MOVED, NO_PLACES, DATED, ASKED_AGAIN, OF_THAT_ORDER, COMPARING,
)
#: Bits of a mask; more classes take more masks.
WIDTH = 60


def texts(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def read(question: Column) -> Column:
    """struct(text, words, line, parts, keys, masks): what the annotators read.

    ``words`` are the runs of letters and digits in lower case, ``line`` is all of them with
    a blank on either side; ``parts`` are what stands between blanks, colons, number signs
    and equal signs, and ``keys`` are these in lower case without marks around; ``masks`` have a
    bit for each class of words that the question holds. A null question reads as an empty one.
    """
    text = F.coalesce(question, F.lit(""))
    bare = _bare(text)
    return let(bare, lambda d: F.struct(*(d[n].alias(n) for n in ("text", "words", "line", "parts", "keys")), masks(d["words"]).alias("masks")))


def _bare(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    parts = F.filter(F.split(text, r"[\s:#=]+"), lambda p: p != "")
    keys = F.transform(parts, lambda p: F.lower(F.trim(p, F.lit(".,;!?()'\""))))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.struct(text.alias("text"), words.alias("words"), line.alias("line"), parts.alias("parts"), keys.alias("keys"))


def _dictionary() -> tuple[list[str], list[list[int]], list[int], list[int]]:
    """(words, their masks, the longest phrase that a word begins, slots): a word stands in the slot of its checksum.

    The number of slots is the first at which no two words share one. Entry 0 is no word.
    """
    masks, begins = {}, {}
    for bit, words in enumerate(dict.fromkeys(CLASSES)):
        for w in words:
            own = masks.setdefault(w, [0] * N_MASKS)
            own[bit // WIDTH] |= 1 << bit % WIDTH
            head, *more = w.split(" ")
            begins[head] = max(begins.get(head, 0), len(more) + 1)
    for head in begins:
        masks.setdefault(head, [0] * N_MASKS)
    words = ["", *sorted(masks)]
    size = next(n for n in range(8 * len(words), 1 << 20) if len({zlib.crc32(w.encode()) % n for w in words[1:]}) == len(words) - 1)
    slots = [0] * size
    for i, w in enumerate(words[1:], 1):
        slots[zlib.crc32(w.encode()) % size] = i
    return words, [masks.get(w, [0] * N_MASKS) for w in words], [begins.get(w, 0) for w in words], slots


def masks(words: Column) -> Column:
    """Masks of all classes that words hold: each word is looked up once, and once more for each phrase it may begin."""
    fixed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731  one literal
    listed = F.split(F.lit(",".join(WORDS)), ",")

    def entry(w: Column) -> Column:
        at = F.get(fixed(SLOTS, "int"), (F.crc32(w.cast("binary")) % len(SLOTS)).cast("int"))
        return let(at, lambda i: F.when(F.get(listed, i) == w, i).otherwise(0))

    first = F.transform(words, entry)

    def phrases(ids: Column) -> Column:
        def longer(i: Column, at: Column) -> Column:
            reach = F.get(fixed(BEGINS, "int"), i)
            phrase = lambda n: F.when((reach >= n) & (F.size(words) >= at + n), entry(F.array_join(F.slice(words, at + 1, n), " "))).otherwise(0)
            return F.when(reach > 1, F.array(i, *(phrase(n) for n in range(2, max(BEGINS) + 1)))).otherwise(F.array(i))

        return F.flatten(F.transform(ids, longer))

    def both(ids: Column) -> Column:
        one = lambda k: F.aggregate(ids, F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(F.get(fixed([m[k] for m in MASKS], "bigint"), i)))
        return F.array(*(one(k) for k in range(N_MASKS)))

    return let(let(first, phrases), lambda ids: both(F.filter(ids, lambda i: i > 0)))


BIT = {words: i for i, words in enumerate(dict.fromkeys(CLASSES))}
N_MASKS = len(BIT) // WIDTH + 1
WORDS, MASKS, BEGINS, SLOTS = _dictionary()


def seen(d: Column, *classes: tuple[str, ...]) -> Column:
    """Whether the question holds any word or phrase of these classes."""
    wanted = [0] * N_MASKS
    for c in classes:
        wanted[BIT[c] // WIDTH] |= 1 << BIT[c] % WIDTH
    out = None
    for k, bits in enumerate(wanted):
        if bits:
            test = F.get(d["masks"], F.lit(k)).bitwiseAND(F.lit(bits).cast("bigint")) != 0
            out = test if out is None else out | test
    return out


def then(d: Column, first: tuple[str, ...], test: Callable[[Column], Column]) -> Column:
    """Whether a word that passes a test stands behind the first word of a class; looked at only where masks say so."""
    at = first_of(F.transform(d["words"], lambda w, i: F.when(w.isin(*first), i)))
    return let(at, lambda i: F.coalesce(F.exists(F.slice(d["words"], i + 2, F.size(d["words"])), test), F.lit(False)))


def let(bound: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(bound), body), F.lit(0))


def first_of(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def scan(items: Column, look: Callable[[Column, Column, Column], Column]) -> Column:
    """The first non-null ``look(item, next item, item after that)``."""
    return first_of(F.transform(items, lambda x, i: look(x, F.get(items, i + 1), F.get(items, i + 2))))


def behind(d: Column, labels: tuple[str, ...], skip: tuple[str, ...] = ()) -> Column:
    """Index in ``keys`` of what stands behind the first label, and behind one more word to skip."""
    keys = d["keys"]
    single, pairs = [w for w in labels if " " not in w], [w.split(" ") for w in labels if " " in w]

    def look(k: Column, i: Column) -> Column:
        out = F.when(k.isin(single), i + 1) if single else F.when(F.lit(False), i)
        for a, b in pairs:
            out = out.when((k == a) & (F.get(keys, i + 1) == b), i + 2)
        return out

    at = first_of(F.transform(keys, look))
    return let(at, lambda i: i + F.when(F.get(keys, i).isin(list(skip)), 1).otherwise(0)) if skip else at


def rest(d: Column, at: Column) -> Column:
    """All parts from an index on, joined by a blank; null without an index."""
    return F.array_join(F.slice(d["parts"], at + 1, F.size(d["parts"])), " ")


def value(text: Column, chars: str, most: int, least: int = 1) -> Column:
    """What the text begins with, as far as these characters go; marks and blanks around do not count."""
    raw = F.substring(F.regexp_extract(text, rf"^['\"]?([{chars}]*)", 1), 1, most)
    return let(F.trim(raw, F.lit(" .,")), lambda x: F.when(F.length(x) >= least, x))


NAME = r"A-Za-z0-9 &\-./,"


def _valid(year: Column, month: Column, day: Column) -> Column:
    dash = F.lit("-")  # concat, unlike concat_ws, is null if a part is
    return F.try_to_date(F.concat(year, dash, F.lpad(month, 2, "0"), dash, F.lpad(day, 2, "0")), "yyyy-MM-dd").cast("string")


def is_year(word: Column) -> Column:
    return (F.length(word) == 4) & word.startswith("20") & F.try_to_number(word, F.lit("9999")).isNotNull()


def date_numeric(d: Column) -> Column:
    """The first valid day of three numbers with a year first or last; month before day, unless it is over 12."""
    keys = F.filter(d["keys"], lambda k: k.rlike(r"^\d+[-/]\d+[-/]\d+$"))

    def look(key: Column) -> Column:
        n = F.split(key, "[-/]")
        a, b, c = n[0], n[1], n[2]
        short = lambda x: F.length(x) <= 2
        swap = a.cast("int") > 12
        last = F.when(is_year(c) & short(a) & short(b), _valid(c, F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)))
        return F.when(is_year(a) & short(b) & short(c), _valid(a, b, c)).otherwise(last)

    return first_of(F.transform(keys, look))


def date_natural(d: Column, default_year: int = 2026) -> Column:
    """A day beside the name of a month (three letters, ``sept`` or all of it); a year anywhere, else the default."""
    words = d["words"]
    names = (*MONTHS, *(m[:3] for m in MONTHS), "sept")
    day = lambda w: F.nullif(F.regexp_extract(w, r"^(\d{1,2})(st|nd|rd|th)?$", 1), F.lit(""))
    year = F.coalesce(first_of(F.transform(words, lambda w: F.when(is_year(w), w))), F.lit(str(default_year)))
    number = lambda w: F.array_position(texts(m[:3] for m in MONTHS), F.left(w, F.lit(3))).cast("string")

    def look(w: Column, i: Column) -> Column:
        return F.when(w.isin(*names), _valid(year, number(w), F.coalesce(day(F.get(words, i - 1)), day(F.get(words, i + 1)))))

    return first_of(F.transform(words, look))


def date_of(d: Column, default_year: int = 2026) -> Column:
    return F.coalesce(date_numeric(d), date_natural(d, default_year))


def date_field(d: Column) -> Column:
    return F.when(seen(d, PICKUP), "pickupdate").when(seen(d, DELIVERY), "deliverydate").otherwise("orderdate")


def period_days(d: Column) -> Column:
    """Days of "last 3 weeks", "past month" and the like; the first in the question."""
    units = {"day": 1, "days": 1, "week": 7, "weeks": 7, "month": 30, "months": 30}
    words = d["words"]

    def days(unit: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for p in units.items() for x in p)), unit)

    def look(w: Column, one: Column, two: Column) -> Column:
        n = F.when(one.rlike(r"^\d{1,5}$"), one.cast("int"))
        single = F.when(one == "one", two).otherwise(one)
        counted = let(n * days(two), lambda x: F.when(x.isNotNull(), F.greatest(F.lit(1), x)))
        return F.when(w.isin(*LAST), F.coalesce(counted, F.when(single.isin("week", "month"), days(single))))

    return scan(words, look)


def status(d: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(STATUSES.items()):
        out = F.when(seen(d, words), name).otherwise(out)
    return out


def side(d: Column) -> Column:
    here, there = seen(d, PICKUP, SENDER), seen(d, DELIVERY, RECEIVER)
    return F.when(here & ~there, "pickup").when(there & ~here, "delivery").otherwise("both")


def direction(d: Column) -> Column:
    return F.when(seen(d, WORST), "worst").otherwise("best")


def metric(d: Column) -> Column:
    return F.when(seen(d, MONEY), "revenue").otherwise("orders")


def country(d: Column) -> Column:
    """Canada before United States; the pronoun "us" counts only behind "in", or in capitals."""
    capitals = F.exists(d["parts"], lambda p: F.trim(p, F.lit(".,;!?()'\"")) == "US")
    return F.when(seen(d, CANADA), "Canada").when(seen(d, AMERICA) | capitals, "United States")


US_CODE, CA_CODE = r"^\d{5}(-\d{4})?$", r"^[a-z]\d[a-z]\d[a-z]\d$"


def pin(d: Column) -> Column:
    """The code behind a label, else five digits behind in, at, for or with (but none that begin like a year)."""
    keys = d["keys"]

    def code(one: Column, two: Column) -> Column:
        return F.when(one.rlike(US_CODE) | one.rlike(CA_CODE), one).when(F.concat(one, two).rlike(CA_CODE), F.concat(one, F.lit(" "), two))

    def labelled(k: Column, i: Column) -> Column:
        at = i + F.when(F.get(keys, i + 1) == "code", 2).otherwise(1)
        return F.when(k.isin(*ZIP), code(F.get(keys, at), F.get(keys, at + 1)))

    bare = scan(keys, lambda k, one, two: F.when(k.isin("in", "at", "for", "with") & one.rlike(US_CODE) & ~one.startswith("20"), one))
    return F.upper(F.coalesce(first_of(F.transform(keys, labelled)), bare))


def order_token(d: Column) -> Column:
    """MRP or TORD numbers, the number behind "order", or a number of four digits or more.

    Years, parts of dates and zip codes are none, and neither are the digits of the pin.
    """
    words, keys = d["words"], d["keys"]
    zips = seen(d, ZIP)
    own = lambda start: F.upper(first_of(F.filter(words, lambda w: w.rlike(rf"^{start}\d+$"))))
    usable = lambda k: ~is_year(k) & ~(zips & k.rlike(r"^\d{5}$"))

    def after_order(k: Column, i: Column) -> Column:
        at = i + F.when(F.get(keys, i + 1).isin("id", "number", "no"), 2).otherwise(1)
        named = F.get(keys, at)
        return F.when((k == "order") & named.rlike(r"^[a-z]*\d+$") & usable(named), F.get(d["parts"], at))

    free = F.filter(keys, lambda k: k.rlike(r"^\d{4,}$") & usable(k))
    token = F.coalesce(own("mrp"), own("tord"), F.trim(first_of(F.transform(keys, after_order)), F.lit(".,;!?()'\"")), F.get(free, F.lit(0)))
    digits = F.coalesce(F.replace(pin(d), F.lit(" "), F.lit("")), F.lit(""))
    return let(token, lambda t: F.when(~digits.contains(F.upper(t)), t))


def codes(d: Column) -> Column:
    """struct(currencycode, customercode, companycode)."""
    keys = d["keys"]
    letters = scan(keys, lambda k, one, two: F.when((k == "currency") & one.rlike("^[a-z]{3}$"), one))
    bare = first_of(F.filter(F.transform(d["parts"], lambda p: F.trim(p, F.lit(".,;!?()'\""))), lambda p: p.isin("CAD", "USD")))
    head = lambda at: F.upper(F.nullif(F.regexp_extract(F.get(keys, at), "^[a-z0-9_-]+", 0), F.lit("")))
    return F.struct(
        F.upper(F.coalesce(letters, bare)).alias("currencycode"),
        head(behind(d, ("customer code", "customercode"))).alias("customercode"),
        head(behind(d, ("company", "companycode"), ("code",))).alias("companycode"),
    )


def customer_name(d: Column) -> Column:
    """The name behind "customer" or "orders for", up to a word that begins something else; none in rankings and counts."""
    keys = d["keys"]
    ends = ("with", "status", "in", "and", "currency")
    ranking = seen(d, CUSTOMERS) & seen(d, BEST, WORST, HOW_MANY)

    def words(at: Column) -> Column:
        end = first_of(F.transform(keys, lambda k, i: F.when((i >= at) & k.isin(*ends), i)))
        return F.array_join(F.slice(d["parts"], at + 1, F.greatest(F.lit(0), F.coalesce(end, F.size(keys)) - at)), " ")

    def named(name: Column) -> Column:
        begins = F.lower(F.element_at(F.split(name, " "), 1))
        junk = begins.isin("with", "by", "for", "of", "the", "a", "an", "in", "on", "from", "to") | F.lower(name).isin(*STATES_OF_ORDER)
        return F.when(~ranking & ~junk, name)

    at = behind(d, ("customer", "orders for", "orders of", "order for", "order of"), ("customer",))
    at = let(at, lambda i: i + F.when(F.get(keys, i).isin("name", "code"), 1).otherwise(0))
    return let(value(let(at, words), NAME, 61, 2), named)


def locations(d: Column) -> Column:
    """struct(pickup_location, delivery_location, location)."""
    no_status = lambda c: F.when(~F.lower(c).isin(*STATES_OF_ORDER), c)
    coded = lambda c: F.lower(F.element_at(F.split(c, "[ .,]"), 1)).isin(*ZIP, "code")
    pickup = value(rest(d, behind(d, PICKUP, ("location", "from"))), NAME, 51, 2)
    drop = let(value(rest(d, behind(d, DELIVERY, ("location", "to"))), NAME, 51, 2), lambda c: F.when(~seen(d, DELIVERED) & ~coded(c), no_status(c)))
    place = let(value(rest(d, behind(d, (*PLACE, "place"))), NAME, 51, 2), no_status)
    both = F.struct(pickup.alias("p"), drop.alias("d"))
    return let(
        both, lambda x: F.struct(x["p"].alias("pickup_location"), x["d"].alias("delivery_location"), F.when(x["p"].isNull() & x["d"].isNull(), place).alias("location"))
    )


def state(d: Column) -> Column:
    """A labelled state, as written if it is unknown; behind in, to, from, at or for only a known one of up to three words."""
    keys = d["keys"]
    raw = value(rest(d, behind(d, ("state", "province", "region"))), r"A-Za-z\s.", 31, 2)

    def labelled(x: Column) -> Column:
        known = F.coalesce(resolve_state(x), resolve_state(F.element_at(F.split(x, " "), 1)))
        return F.coalesce(known, F.when(F.length(x) <= 3, F.upper(x)).otherwise(title_case(x)))

    def look(k: Column, i: Column) -> Column:
        words = lambda n: F.when(F.size(keys) > i + n, resolve_state(F.array_join(F.slice(keys, i + 2, n), " ")))
        one = F.get(keys, i + 1)
        return F.when(k.isin("in", "to", "from", "at", "for"), F.coalesce(words(3), words(2), F.when(~one.isin(*NO_STATES), words(1))))

    return F.coalesce(let(raw, labelled), first_of(F.transform(keys, look)))


def city_address(d: Column) -> Column:
    """struct(city, address, salesmanname, commodityname)."""
    under = lambda labels, chars, most, least: value(rest(d, behind(d, labels)), chars, most, least)
    return F.struct(
        under(("city", "town"), r"A-Za-z\s\-.", 41, 2).alias("city"),
        under(("address", "street"), NAME + "#", 61, 3).alias("address"),
        under(("salesman", "salesperson", "sales person", "sales rep"), NAME, 51, 2).alias("salesmanname"),
        under(("commodity", "product"), NAME, 51, 2).alias("commodityname"),
    )


def sort_limit(d: Column) -> Column:
    """struct(sort_by, ascending, limit)."""
    low = seen(d, SORT_LOW) & seen(d, SORT_LOW_BY) & then(d, SORT_LOW, lambda w: w.isin(*SORT_LOW_BY))
    top = seen(d, SORT_TOP) & seen(d, SORT_TOP_BY)
    holds = lambda *stems: reduce(lambda a, b: a | b, (d["line"].contains(x) for x in stems))
    by = F.when(holds("tax"), "taxes").when(holds("distance"), "distance_num").when(~low & holds("revenue", "gross"), "grosstotalfreight").otherwise("totalfreight")
    asked = scan(d["words"], lambda w, one, two: F.when(w.isin("top", "last", "recent", "show", "list") & one.rlike(r"^\d{1,3}$"), one.cast("int")))
    limit = F.coalesce(F.when(asked.isNotNull(), F.least(F.lit(50), F.greatest(F.lit(1), asked))), F.when(seen(d, EVERY) & seen(d, ORDER), 25), F.when(top | low, 5))
    return F.struct(F.when(top | low, by).alias("sort_by"), F.when(top | low, low).alias("ascending"), limit.alias("limit"))


def _common(names: list[str]) -> str:
    """The longest text that all names hold."""
    short = min(names, key=len)
    parts = (short[i:j] for i in range(len(short)) for j in range(len(short), i, -1))
    return max((p for p in parts if all(p in n for n in names)), key=len, default="")


def formulas(d: Column) -> Column:
    """Ids of the formulas a question names, longest alias first; else the general ones."""
    low = F.lower(d["text"])
    scored = []
    for i, (name, _, _) in enumerate(FORMULAS):
        length, aliases = F.lit(0), sorted({*ALIASES.get(name, ()), name.replace("_", " "), name}, key=len)
        for alias in aliases:
            length = F.when(low.contains(alias), len(alias)).otherwise(length)
        if stem := _common(aliases):
            length = F.when(low.contains(stem), length).otherwise(0)
        scored.append(F.struct((-length).alias("minus"), F.lit(i).alias("i"), F.lit(name).alias("id")))
    hit = F.transform(F.sort_array(F.filter(F.array(*scored), lambda x: x["minus"] < 0)), lambda x: x["id"])
    wide = seen(d, WIDE)
    general = (
        F.when(seen(d, COUNTING) & seen(d, ORDER), texts(["order_count"]))
        .when(low.contains("tax") & wide, texts(["total_taxes"]))
        .when(low.contains("freight") & wide, texts(["total_freight"]))
        .when(seen(d, OVERALL), texts(["order_count", "total_revenue", "total_freight", "total_taxes"]))
        .otherwise(texts([]))
    )
    return F.when(F.size(hit) > 0, hit).otherwise(general)


def topics(d: Column, day: Column | None = None, days: Column | None = None, named_country: Column | None = None, ids: Column | None = None) -> Column:
    """struct of booleans: what a question is about. Each topic is a set of word classes that stand together.

    ``day``, ``days``, ``named_country``, ``ids``: the question's date, period, country and
    formulas, where they are known already.
    """
    day = date_of(d) if day is None else day
    days = period_days(d) if days is None else days
    named_country = country(d) if named_country is None else named_country
    ids = formulas(d) if ids is None else ids
    counting, orders, customer = seen(d, COUNTING), seen(d, ORDER), seen(d, CUSTOMER)
    of_status, ranked = seen(d, STATES_OF_ORDER), seen(d, BEST, WORST)
    counted = counting | seen(d, SHARES, TOTAL)
    listing = seen(d, LISTING, GET) & ~counted
    statuses = ~listing & (
        (seen(d, STATUS_WORDS) & (counting | seen(d, SHARES))) | (of_status & counting) | (of_status & orders & seen(d, STATUS_SHARES))
    )
    in_country = named_country.isNotNull() & (counting | customer | seen(d, IN_COUNTRY))
    dated = day.isNotNull() & (
        counting | customer | orders | seen(d, ON_A_DAY)
    )
    plain = (orders | counting | seen(d, PLACE_SHARES)) & ~seen(d, NO_PLACE_COUNT)
    by_state = seen(d, BY_STATE) | (seen(d, STATES) & plain)
    best_city = seen(d, CITY) & seen(d, BEST)
    by_city = ~best_city & (seen(d, BY_CITY) | (seen(d, CITIES) & plain))
    period = days.isNotNull() & (counting | orders | seen(d, IN_A_PERIOD))
    order_named = d["line"].rlike(r" (mrp|tord)\d+ ")
    trip = ~order_named & (seen(d, TRIP) | (seen(d, DISTANCE) & seen(d, ADDING, FLEET)))
    named = {
        "status_summary": statuses, "customer_rank": customer & ranked, "country_customers": in_country, "activity_on_date": dated,
        "by_state": by_state, "by_city": by_city, "best_city": best_city, "period": period, "trip": trip,
    }
    any_topic = F.lit(False)
    for c in named.values():
        any_topic = any_topic | c
    sums = seen(d, ADDING, COUNTING, CALCULATING)
    fields = reduce(lambda a, b: a | b, (d["line"].contains(x) for x in ("revenue", "tax", "freight", "fuel", "offered", "distance", "profit")))
    named |= {"analytics": any_topic, "calculation": ~any_topic & ((F.size(ids) > 0) | sums | fields)}
    return F.struct(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in named.items()))


def intent(d: Column, t: Column, token: Column, has_history: Column | None = None) -> Column:
    """struct(intent, reason): the first rule that matches. ``t``: topics, ``token``: the order token."""
    history = F.lit(False) if has_history is None else has_history
    orders, named = seen(d, ORDER), token.isNotNull()
    order_word = d["line"].contains(" order")
    zips, n_words = seen(d, ZIP), F.size(d["parts"])
    counted = seen(d, COUNTING, ADDING)
    listed = (seen(d, LISTING, WHICH) & order_word & then(d, (*LISTING, *WHICH), lambda w: w.startswith("order"))) | seen(d, ORDERSTATUS)
    compared, asked = seen(d, COMPARE), seen(d, ASKING)
    only_token = (F.size(d["words"]) == 1) & named
    lookup = named & ~zips & ~seen(d, REGION) & (asked | only_token | (n_words <= 8))
    lookup = lookup & (~seen(d, NO_LOOKUP) | (seen(d, DETAILS) & ~compared))
    numbered = d["line"].rlike(r" ((mrp|tord)\d+|\d{4,}) ")
    measured = seen(d, MEASURED)
    ranked = seen(d, RANKED) & measured & ~seen(d, ONE_CUSTOMER) & then(d, RANKED, lambda w: w.isin(*MEASURED))
    by_status = seen(d, LISTING) & seen(d, STATES_OF_ORDER) & ~seen(d, COUNTING, SHARES, TOTAL)
    numbered_last = scan(d["words"], lambda w, one, two: F.when(w.isin("last", "top") & one.rlike(r"^\d+$"), F.lit(True)))
    recent = (seen(d, RECENT) | F.coalesce(numbered_last, F.lit(False))) & order_word & ~t["calculation"]
    moved = orders | seen(d, MOVED)
    toward = scan(d["words"], lambda w, one, two: F.when(w.isin("in", "from", "to", "at") & one.rlike("^[a-z]{2}"), F.lit(True)))
    places = zips | seen(d, REGION) | (seen(d, PLACE) & moved) | (orders & F.coalesce(toward, F.lit(False)))
    places = places & ~(seen(d, NO_PLACES) | (seen(d, HOW_MANY) & seen(d, CUSTOMERS)))
    with_words = ("with", "for", "by", "in")
    linked = scan(d["words"], lambda w, one, two: F.when(w.isin(*ORDER) & one.isin(*with_words), F.lit(True)))
    a_status = scan(d["words"], lambda w, one, two: F.when((w == "status") & one.isin("confirmed", "delivered", "dispatched", "cancelled", "quoted"), F.lit(True)))
    in_year = seen(d, DATED) & d["line"].rlike(r" 20\d\d ")
    filtered = (listed | F.coalesce(linked, a_status, F.lit(False)) | in_year) & ~counted
    follow = history & seen(d, FOLLOW_UP, ASKED_AGAIN) & seen(d, OF_THAT_ORDER)
    rules = (
        (F.size(d["parts"]) == 0, "empty", "empty"),
        (F.trim(d["line"]).isin(*GREETINGS), "greeting", "greeting_or_thanks"),
        (t["activity_on_date"], "analytics", "activity_on_date"),
        (lookup, "order_lookup", "explicit_order_token"),
        (seen(d, COMPARING) & numbered, "compare", "compare_orders"),
        (ranked, "list_filter", "ranked_list"),
        (by_status, "list_filter", "status_filtered_list"),
        (t["customer_rank"] & (direction(d) == "worst"), "analytics", "worst_customer"),
        (t["customer_rank"], "analytics", "best_customer"),
        (t["best_city"], "analytics", "best_city"),
        (t["by_state"], "analytics", "state_wise_orders"),
        (t["by_city"], "analytics", "city_wise_orders"),
        (t["period"], "analytics", "period_orders"),
        (t["trip"], "analytics", "trip_distance"),
        (t["status_summary"], "analytics", "status_summary"),
        (t["analytics"], "analytics", "country_or_analytics"),
        (recent, "list_recent", "list_recent"),
        (places, "list_filter", "geo_or_address_filter"),
        (filtered, "list_filter", "filtered_list"),
        (named & asked, "order_lookup", "explicit_order_lookup"),
        (named & (n_words <= 4), "order_lookup", "short_order_token"),
        (follow, "order_lookup", "follow_up_with_session"),
        (t["calculation"], "calculation", "calculation_keywords"),
    )
    none = F.struct(F.lit("none").alias("intent"), F.lit("none").alias("reason"))
    named_rules = [F.when(test, F.struct(F.lit(name).alias("intent"), F.lit(why).alias("reason"))) for test, name, why in rules]
    return F.coalesce(*named_rules, none)


def analytics_type(t: Column) -> Column:
    """Which analysis a question asks for."""
    order = ("activity_on_date", "period", "best_city", "by_state", "by_city", "trip", "customer_rank", "country_customers", "status_summary")
    return F.coalesce(*(F.when(t[name], name) for name in order))


FILTERS = (
    "orderstatus", "currencycode", "customercode", "companycode", "customername", "pickup_location", "delivery_location",
    "orderdate", "pickupdate", "deliverydate", "pin", "state", "city", "address", "location", "salesmanname", "commodityname",
)


def filter_columns(d: Column) -> dict[str, Column]:
    """The filters a question names, by name."""
    c, loc, more, day, field = codes(d), locations(d), city_address(d), date_of(d), date_field(d)
    dates = {f: F.when(field == f, day) for f in ("orderdate", "pickupdate", "deliverydate")}
    return {
        "orderstatus": status(d), "currencycode": c["currencycode"], "customercode": c["customercode"], "companycode": c["companycode"],
        "customername": customer_name(d), "pickup_location": loc["pickup_location"], "delivery_location": loc["delivery_location"],
        **dates, "pin": pin(d), "state": state(d), "city": more["city"], "address": more["address"], "location": loc["location"],
        "salesmanname": more["salesmanname"], "commodityname": more["commodityname"],
    }


def filter_map(columns: dict[str, Column]) -> Column:
    full = F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), c)))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def follow_up(d: Column) -> Column:
    """Whether a question leans on what was said before."""
    return seen(d, FOLLOW_UP)


def about_last_order(d: Column) -> Column:
    """Whether a question without an order token is about the last order: a follow-up, or a word for what an order has."""
    return seen(d, FOLLOW_UP, OF_AN_ORDER)
