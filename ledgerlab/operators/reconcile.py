"""Two ledgers -> scenarios: A company only, B authority only, C differing, D equal."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ledgerlab.errors import InvalidSpec
from ledgerlab.operators import ledger as L
from ledgerlab.operators.receipts import receipts_as_scenarios, receipts_by_day
from ledgerlab.session import shuffles_dropped

BOOKS = {"ventas": L.SALES_TYPES, "compras": L.PURCHASE_TYPES}
LATE_MONTHS = 12
KEYS = ["periodo", *L.KEY]
# What a key is compared by, the most telling part first: a sort decides most comparisons by the first eight bytes.
_MATCH = ["k_numero", "k_serie", "k_ruc", "k_tipo", "k_periodo"]
_KEY_OF = {"ruc_proveedor": "k_ruc", "tipo_cdp": "k_tipo", "serie": "k_serie", "numero": "k_numero"}

_CARRIED = ["tipo_cdp", "serie", "numero", "ruc_proveedor", "razon_social", "fecha_emision",
            *L.AMOUNTS, "moneda", "tipo_cambio", "status_description"]

# Amounts compared in each book, in report order, with their tolerance.
_BOTH = [("base_imponible", L.TOL_AMOUNT), ("igv", L.TOL_IGV), ("importe_total", L.TOL_AMOUNT)]
_PURCHASES = [("bi_dgng", L.TOL_AMOUNT), ("igv_dgng", L.TOL_IGV), ("bi_dng", L.TOL_AMOUNT),
              ("igv_dng", L.TOL_IGV), ("valor_adq_ng", L.TOL_AMOUNT)]
_SALES = [("mto_exonerado", L.TOL_AMOUNT), ("mto_inafecto", L.TOL_AMOUNT)]


def _detail(field: str, company: Column, authority: Column, difference: Column | None) -> Column:
    return F.struct(
        F.lit(field).alias("campo"), company.cast("string").alias("valor_empresa"),
        authority.cast("string").alias("valor_sunat"),
        (F.lit(None) if difference is None else difference).cast("decimal(19,3)").alias("diferencia"),
    )


def diff_fields(book: str) -> Column:
    """ARRAY<STRUCT> of the fields of `e_` (company) and `s_` (authority) beyond tolerance."""
    return F.array_compact(F.array(*[
        F.when(apart, _detail(name, F.col(f"e_{field}"), F.col(f"s_{field}"), difference)) for name, field, apart, difference in _compared(book)]))


def differs(book: str) -> Column:
    """Whether `diff_fields` has any, told without building them."""
    return F.coalesce(reduce(lambda a, b: a | b, [apart for _, _, apart, _ in _compared(book)]), F.lit(False))


def _compared(book: str) -> list[tuple[str, str, Column, Column | None]]:
    """(name, column, whether beyond tolerance, difference) of each compared field."""
    e, s = (lambda n: F.col(f"e_{n}")), (lambda n: F.col(f"s_{n}"))

    def amount(field: str, tolerance: str, dtype: str = L.MONEY):
        zero = F.lit(0).cast(dtype)
        difference = F.coalesce(e(field), zero) - F.coalesce(s(field), zero)
        return field, field, F.abs(difference) > F.lit(tolerance).cast(dtype), difference

    parts = [("fecha", "fecha_emision", e("fecha_emision") != s("fecha_emision"), None)]
    parts += [amount(*f) for f in _BOTH + (_PURCHASES if book == "compras" else _SALES)]
    if book == "compras":
        apart = (e("moneda") != "") & (s("moneda") != "") & (L.clean_upper(e("moneda")) != L.clean_upper(s("moneda")))
        parts += [("moneda", "moneda", apart, None), amount("tipo_cambio", L.TOL_RATE, L.RATE)]
    return parts


def _igv(side: str) -> Column:
    return sum((F.col(f"{side}_{n}") for n in L.IGV_FIELDS[1:]), F.col(f"{side}_{L.IGV_FIELDS[0]}"))


def _red_difference(diffs: Column) -> Column:
    return F.exists(diffs, lambda d: d["campo"].isin(L.IGV_FIELDS) & (F.abs(d["diferencia"]) > F.lit(L.RED_IGV).cast(L.MONEY)))


def _matched(rows: DataFrame, side: str) -> DataFrame:
    """Rows with the columns of `_MATCH`. None of them is null, so joins add no null filters that would keep the shuffles of
    one ledger from being shared; a row without a period bears its side instead, which no other side's row does. The type is
    written anew, or a filter on it would go over to the other side of some joins with the same effect."""
    period = F.coalesce(F.concat(F.lit("="), F.col("periodo").cast("string")), F.lit(side))
    return rows.withColumns({"k_periodo": period, "k_tipo": F.concat("k_tipo", F.lit(""))})


def _once(rows: DataFrame, side: str) -> DataFrame:
    """The last row of every key: `e_hay` (or `s_hay`) and a column for each carried one, `e_igv`.

    They are columns and not a struct, so those that a scenario does not ask for leave before the shuffle; so do texts that
    equal their key (`_own_text` fills them again). `e_hay` is made of the rank: were it a constant, the optimizer would ask for
    fewer columns in one of two joins, and they would not read one shuffle.
    """
    slim = _matched(rows, side).withColumns({n: F.nullif(F.col(n), F.col(k)) for n, k in _KEY_OF.items()})
    last = L.last_per_key(slim, _MATCH, "hay")
    return last.select(*_MATCH, F.nullif("hay", F.lit(0)).alias(f"{side}_hay"), *[F.col(n).alias(f"{side}_{n}") for n in _CARRIED])


def _own_text(name: str) -> Column:
    """A text of the key as the company writes it, or the authority where the company has no row."""
    written = F.when(F.col("e_hay").isNotNull(), F.col(f"e_{name}")).otherwise(F.col(f"s_{name}"))
    return F.coalesce(written, F.col(_KEY_OF[name])).alias(name)


def _keys_once(rows: DataFrame, side: str) -> DataFrame:
    """Every key once and nothing else; ranked like `last_per_key`, so that a hot key sends a row per task."""
    rank = F.row_number().over(Window.partitionBy(_MATCH).orderBy("k_numero"))
    return _matched(rows, side).select(*_MATCH, rank.alias("_rank")).filter("_rank = 1").drop("_rank")


def _with_period(pairs: DataFrame, kind: DataType) -> DataFrame:
    """`periodo` of `k_periodo`."""
    own = F.col("k_periodo")
    return pairs.withColumn("periodo", F.when(own.startswith("="), F.substring(own, 2, 2**31 - 1)).cast(kind))


def _present_days(rows: DataFrame, coverage: list[str] | None, authority: DataFrame) -> DataFrame:
    """(periodo, dia) the company file has dates for, or the declared days."""
    days = rows.select("periodo", F.col("fecha_emision").alias("dia")).filter("dia is not null").distinct()
    if coverage is None:
        return days
    listed = F.explode(F.array(*[F.lit(d).cast("date") for d in sorted(set(coverage))]))
    return authority.select("periodo").distinct().select("periodo", listed.alias("dia"))


@dataclass
class Reconciliation:
    """Lazy results. To read several scenarios, store `rows` once (`session.cut_lineage` or the
    scenario writer) and pass the stored table to `scenario`."""

    book: str
    company: DataFrame
    authority: DataFrame
    coverage: list[str] | None = None
    late: bool = False

    @cached_property
    def ours(self) -> DataFrame:
        """Keyed company rows of the types this book matches document by document."""
        return eligible(self.company, self.book).filter(F.col("k_tipo").isin(BOOKS[self.book]))

    @cached_property
    def theirs(self) -> DataFrame:
        """Keyed authority rows (receipts apart)."""
        return L.with_key(self.authority.filter(~L.is_receipt()) if self.book == "ventas" else self.authority)

    @property
    def _period_kind(self) -> DataType:
        return self.company.schema["periodo"].dataType

    @cached_property
    def pairs(self) -> DataFrame:
        """One row per key: its period, the company's columns `e_...` and the authority's `s_...`; `e_hay`, `s_hay` tell a missing side."""
        return self._pairs("full_outer")

    def _pairs(self, how: str) -> DataFrame:
        """`pairs`, or with `inner` those that both sides have: the join needs fewer columns, and both joins read one shuffle of a ledger."""
        ours, theirs = _once(self.ours, "e"), _once(self.theirs, "s")
        pairs = _with_period(ours.join(theirs, _MATCH, how), self._period_kind).withColumn("periodo_hallazgo", F.lit(""))
        return self._rescued(pairs, ours, theirs, how) if self.late else pairs

    def _alone(self, letter: str) -> DataFrame:
        """`pairs` of a scenario that only one side has: of the other side the keys are enough."""
        own, other, name, empty = (self.ours, self.theirs, "e", "s") if letter == "A" else (self.theirs, self.ours, "s", "e")
        keys = _keys_once(other, empty)
        rows = _with_period(_once(own, name).join(keys, _MATCH, "left_anti"), self._period_kind)
        if letter == "A" and self.late:
            # Rows that ask for no other month ask for their own again: it has not been found, and they stay.
            month = F.coalesce(F.when(_is_late(), F.concat(F.lit("="), _issued())), F.col("k_periodo"))
            rows = rows.withColumn("b_periodo", month)
            rows = rows.join(_named(keys), _asked(rows), "left_anti").drop("b_periodo")
        both = [*rows.columns, "e_hay", "s_hay", *[f"{side}_{n}" for side in "es" for n in _CARRIED]]
        kinds = {f"{empty}_{n}": other.schema[n].dataType for n in _CARRIED} | {f"{empty}_hay": "int"}
        return rows.select(*[F.lit(None).cast(kinds[n]).alias(n) if n in kinds else F.col(n) for n in dict.fromkeys(both)], F.lit("").alias("periodo_hallazgo"))

    def _rescued(self, pairs: DataFrame, ours: DataFrame, theirs: DataFrame, how: str) -> DataFrame:
        """Fill the authority side of company-only rows from the proposal of their issue month.

        Only rows that ask for another month, those issued within the twelve months before their period and not matched in it,
        are joined again; all other pairs stay where they are.
        """
        settled = pairs if how == "inner" else pairs.filter(F.col("s_hay").isNotNull() | ~_is_late())
        asking = _with_period(ours, self._period_kind).filter(_is_late()).join(_keys_once(self.theirs, "s"), _MATCH, "left_anti")
        asking = asking.withColumn("b_periodo", F.concat(F.lit("="), _issued()))
        month = F.when(F.col("s_hay").isNotNull(), _issued()).otherwise("")
        rescued = asking.join(_named(theirs), _asked(asking), "inner" if how == "inner" else "left").withColumn("periodo_hallazgo", month)
        return settled.unionByName(rescued.select(settled.columns))

    @cached_property
    def receipts(self) -> DataFrame | None:
        """Receipts by series and day, sales only."""
        return receipts_by_day(self.company, self.authority) if self.book == "ventas" else None

    @cached_property
    def excluded(self) -> DataFrame:
        """Company rows of types the book does not match, counted per type."""
        return excluded_types(self.company, self.book)

    @cached_property
    def surplus(self) -> DataFrame:
        """Rows beyond the first of each key, per side."""
        sides = {"empresa": self.ours, "sunat": self.theirs}
        return reduce(DataFrame.unionByName, [
            L.surplus_per_key(rows, KEYS).select(F.lit(side).alias("lado"), "sobrantes") for side, rows in sides.items()])

    def _covered(self, pairs: DataFrame) -> DataFrame:
        if self.book != "ventas" or self.coverage == []:
            return pairs
        return _within_coverage(pairs, _present_days(self.ours, self.coverage, self.theirs))

    def _build(self, pairs: DataFrame, folder: str | None = None) -> DataFrame:
        narrow = _narrow(pairs, self.book)
        rows = _scenarios(narrow if folder is None else _gathered(_kept(narrow, folder)), self.book)
        if self.receipts is None:
            return rows
        daily = receipts_as_scenarios(self.receipts).withColumn("igv_total", F.coalesce("igv_empresa", "igv_sunat"))
        texts = ["ruc_proveedor", "razon_social", "status_description", "periodo_hallazgo"]
        return rows.unionByName(daily if folder is None else _gathered(daily), allowMissingColumns=True).na.fill("", texts)

    @property
    def rows(self) -> DataFrame:
        """All scenarios as one table with an `escenario` column."""
        return self._build(self._covered(self.pairs))

    def gathered_rows(self, folder: str) -> DataFrame:
        """`rows` with those of a period and scenario in few tasks, for a writer that parts by both.

        Pairs are kept in a folder first, before the differences and what else follows from them make them wide: the shuffles of
        the ledgers are dropped before the pairs are shuffled.
        """
        return self._build(self._covered(self.pairs), folder)

    def scenario(self, letter: str, stored: DataFrame | None = None) -> DataFrame:
        """Rows of one scenario with its report columns."""
        if letter not in ("A", "B", "C", "D"):
            raise InvalidSpec(f"unknown scenario: {letter!r}")
        if stored is None:
            # Days only decide about authority-only rows, and the rescue about company-only ones.
            pairs = self._alone(letter) if letter in "AB" else self._pairs("inner")
            stored = self._build(self._covered(pairs) if letter == "B" else pairs)
        rows = stored.filter(F.col("escenario") == letter)
        head = ["periodo", "tipo_cdp", "serie", "numero"]
        if letter == "A":
            return rows.select(
                *head, F.col("fecha_emision_empresa").alias("fecha_emision"),
                F.col("base_imponible_empresa").alias("base_imponible"), F.col("igv_total").alias("igv"),
                F.col("importe_total_empresa").alias("importe_total"), "es_alerta_roja",
                "status_description", "ruc_proveedor", "razon_social")
        if letter == "B":
            return rows.select(
                *head, F.col("fecha_emision_sunat").alias("fecha_emision"), "base_imponible_sunat",
                F.col("igv_total").alias("igv_sunat"), "importe_total_sunat", "es_alerta_roja",
                "ruc_proveedor", "razon_social")
        dates = ["fecha_emision_empresa", "fecha_emision_sunat"]
        shown = L.AMOUNTS if letter == "C" else L.AMOUNTS[:5]
        amounts = [f"{n}_{s}" for n in shown for s in ("empresa", "sunat")]
        tail = ["ruc_proveedor", "razon_social", "periodo_hallazgo", "moneda_empresa", "moneda_sunat",
                "tipo_cambio_empresa", "tipo_cambio_sunat"]
        extra = ["diferencias", "es_alerta_roja"] if letter == "C" else []
        return rows.select(*head, *dates, *amounts, *extra, *tail)

    def summary(self, stored: DataFrame | None = None) -> DataFrame:
        """One row: counts, IGV difference, conciliation rate and alert flag."""
        rows = self.rows if stored is None else stored
        letter = F.col("escenario")
        igv = F.when(letter == "B", F.abs("igv_total")).when(letter == "C", F.aggregate(
            F.filter("diferencias", lambda d: d["campo"].isin(L.IGV_FIELDS)),
            F.lit(0).cast("decimal(28,3)"),
            lambda acc, d: (acc + F.coalesce(F.abs(d["diferencia"]), F.lit(0).cast("decimal(19,3)"))).cast("decimal(28,3)")))
        counts = [F.count_if(letter == x).alias(f"escenario_{x.lower()}") for x in "ABCD"]
        late = F.count_if(F.col("periodo_hallazgo") != "").alias("reubicados")
        out = rows.agg(
            *counts, late,
            F.coalesce(F.round(F.sum(igv), 2), F.lit(0)).cast("decimal(28,2)").alias("igv_diferencia_total"),
            F.coalesce(F.max(F.col("es_alerta_roja") & (letter != "D")), F.lit(False)).alias("tiene_alertas_rojas"))
        compared = F.col("escenario_a") + F.col("escenario_c") + F.col("escenario_d")
        rate = F.round(F.col("escenario_d").cast("double") / F.nullif(compared, F.lit(0)), 4)
        return out.withColumn("tasa_conciliacion", rate)


def eligible(company: DataFrame, book: str) -> DataFrame:
    """Keyed rows of a conformed company ledger, receipts apart for sales."""
    rows = L.with_key(company)
    if book == "ventas":
        rows = rows.filter(~L.is_receipt())
    return rows


def excluded_types(company: DataFrame, book: str = "ventas") -> DataFrame:
    """Company rows of types the book does not reconcile, counted per type."""
    rows = eligible(company, book).filter(~F.col("k_tipo").isin(BOOKS[book]))
    return rows.groupBy(F.col("k_tipo").alias("tipo_cdp")).agg(F.count(F.lit(1)).alias("cantidad"))


def reconcile(
    company: DataFrame,
    authority: DataFrame,
    book: str = "ventas",
    coverage: list[str] | None = None,
    late: bool = False,
) -> Reconciliation:
    """Match two ledgers on (period, ruc, type, series, number).

    Ledgers without `periodo` count as one period. Every side is reduced to one row per key
    before the full outer join, so no key is hot in the join, and the join reuses the
    partitioning of that step. `coverage` lists the days the company declares; an empty list means
    the whole month, None the days found in its rows. `late` (purchases) looks for unmatched company rows in the
    proposal of their issue month, up to twelve periods back.
    """
    if book not in BOOKS:
        raise InvalidSpec(f"unknown book: {book!r}")
    return Reconciliation(book, L.conform(company), L.conform(authority), coverage, late)


def _within_coverage(pairs: DataFrame, days: DataFrame) -> DataFrame:
    """Drop authority-only rows of days outside the company file; a file without dates drops none."""
    marked = days.select(F.col("periodo").alias("d_periodo"), F.col("dia"), F.lit(True).alias("cubierto"))
    day = F.col("s_fecha_emision")
    out = pairs.join(marked, (pairs.periodo == F.col("d_periodo")) & (day == F.col("dia")), "left")
    # Periods are calendar months: the set of those with dates is a short array.
    dated = days.agg(F.collect_set("periodo").alias("p")).scalar()
    keep = F.col("e_hay").isNotNull() | F.col("cubierto").isNotNull() | ~F.array_contains(dated, F.col("periodo"))
    return out.filter(keep).select(pairs.columns)


def _issued() -> Column:
    return F.date_format("e_fecha_emision", "yyyyMM")


def _is_late() -> Column:
    """Whether a row was issued within the twelve months before its period."""
    first = F.to_date(F.concat("periodo", F.lit("01")), "yyyyMMdd")
    oldest = F.date_format(F.add_months(first, -LATE_MONTHS), "yyyyMM")
    return F.coalesce((_issued() < F.col("periodo")) & (_issued() >= oldest), F.lit(False))


def _named(keyed: DataFrame) -> DataFrame:
    """Keyed rows with their keys named `f_...`, to be joined by another period than the own one."""
    return keyed.select(*[F.col(n).alias(f"f_{n}") if n in _MATCH else F.col(n) for n in keyed.columns])


def _asked(rows: DataFrame) -> Column:
    """Rows that ask for the period `b_periodo` meet the keys of `_named`."""
    return reduce(lambda a, b: a & b, [rows["b_periodo" if n == "k_periodo" else n] == F.col(f"f_{n}") for n in _MATCH])


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows of a period and scenario in few tasks (adaptive execution splits large ones)."""
    return rows.hint("rebalance", "periodo", "escenario")


def _kept(rows: DataFrame, folder: str) -> DataFrame:
    """Rows as they are read back from a folder that nothing else uses."""
    with shuffles_dropped(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


# What the authority has like the company in most pairs, and never NULL.
_ALIKE = [*L.AMOUNTS, "moneda"]


def _narrow(pairs: DataFrame, book: str) -> DataFrame:
    """What a row of a scenario is made of, its letter included; of `_ALIKE` the authority's only where it differs."""
    letter = F.when(F.col("s_hay").isNull(), "A").when(F.col("e_hay").isNull(), "B").when(differs(book), "C").otherwise("D")
    name = F.coalesce(F.nullif(F.col("e_razon_social"), F.lit("")), F.col("s_razon_social"), F.lit(""))
    # What is alike lies together at the end, mostly as one run of zeros, and the letter tells which side is there: both make the shuffle smaller.
    ours = [f"e_{n}" for n in ("fecha_emision", "moneda", "tipo_cambio", *L.AMOUNTS)]
    alike = [F.nullif(F.col(f"s_{n}"), F.col(f"e_{n}")).alias(f"s_{n}") for n in _ALIKE]
    return pairs.select(
        letter.alias("escenario"), "periodo", *[_own_text(n) for n in ("tipo_cdp", "serie", "numero", "ruc_proveedor")], name.alias("razon_social"),
        F.coalesce("e_status_description", F.lit("")).alias("status_description"), "periodo_hallazgo", *ours, "s_fecha_emision", "s_tipo_cambio", *alike)


def _scenarios(narrow: DataFrame, book: str) -> DataFrame:
    """Rows of `_narrow` with all that follows from a pair."""
    letter = F.col("escenario")
    full = narrow.withColumns({f"s_{n}": F.when(letter != "A", F.coalesce(f"s_{n}", f"e_{n}")) for n in _ALIKE})
    compared = full.withColumn("diferencias", F.when(letter.isin("C", "D"), diff_fields(book)))
    igv_total = F.coalesce(_igv("e"), _igv("s"))
    one_sided = F.abs(igv_total) > F.lit(L.RED_IGV).cast(L.MONEY)
    red = F.when(letter.isin("A", "B"), one_sided).when(letter == "C", _red_difference(F.col("diferencias"))).otherwise(False)
    both = [c for n in L.AMOUNTS for c in (F.col(f"e_{n}").alias(f"{n}_empresa"), F.col(f"s_{n}").alias(f"{n}_sunat"))]
    return compared.select(
        "escenario", "periodo", "tipo_cdp", "serie", "numero",
        F.col("e_fecha_emision").alias("fecha_emision_empresa"), F.col("s_fecha_emision").alias("fecha_emision_sunat"),
        *both, "diferencias", red.alias("es_alerta_roja"), igv_total.cast(L.MONEY).alias("igv_total"),
        "ruc_proveedor", "razon_social", "status_description", "periodo_hallazgo",
        F.col("e_moneda").alias("moneda_empresa"), F.col("s_moneda").alias("moneda_sunat"),
        F.col("e_tipo_cambio").alias("tipo_cambio_empresa"), F.col("s_tipo_cambio").alias("tipo_cambio_sunat"),
    )


def months_to_fetch(company: DataFrame, period: str) -> DataFrame:
    """Issue months of the company rows within the twelve periods before `period`."""
    first = F.to_date(F.lit(period + "01"), "yyyyMMdd")
    month = F.date_format("fecha_emision", "yyyyMM")
    oldest = F.date_format(F.add_months(first, -LATE_MONTHS), "yyyyMM")
    return L.conform(company).select(month.alias("mes")).filter(
        (F.col("mes") >= oldest) & (F.col("mes") < period)).distinct().orderBy("mes")


# Order of the difference labels in reports.
DIFFERENCE_LABELS = {
    "fecha": "Fecha", "base_imponible": "Base imponible", "igv": "IGV", "bi_dgng": "BI DGNG",
    "igv_dgng": "IGV DGNG", "bi_dng": "BI DNG", "igv_dng": "IGV DNG", "valor_adq_ng": "Adq. no gravadas",
    "importe_total": "Importe total", "moneda": "Moneda", "tipo_cambio": "Tipo de cambio",
    "mto_exonerado": "Exonerado", "mto_inafecto": "Inafecto",
}
# Status codes of a voucher at the authority.
VALIDITY = {"0": "NO EXISTE", "1": "ACEPTADO", "2": "ANULADO", "3": "AUTORIZADO", "4": "NO AUTORIZADO"}


def difference_text(diffs: Column) -> Column:
    """'IGV, Importe total': labels of the differing fields in report order."""
    fields = F.transform(diffs, lambda d: d["campo"])
    return F.array_join(F.array_compact(F.array(*[
        F.when(F.array_contains(fields, name), F.lit(label)) for name, label in DIFFERENCE_LABELS.items()])), ", ")


def order_authority_only(b: DataFrame) -> DataFrame:
    """Scenario B for reading: red rows first, then the largest IGV."""
    return b.orderBy(F.desc("es_alerta_roja"), F.desc("igv_sunat"), "tipo_cdp", "serie", "numero")


def validation_worklist(a: DataFrame, duplicates: DataFrame, limit: int | None = None) -> DataFrame:
    """Vouchers to check with the authority: all duplicates, then the rows of scenario A (the first
    `limit` of them, if given), one row per (type, series, number)."""
    shown = ["tipo_cdp", "serie", "numero", "fecha_emision", "importe_total"]
    first = a.select(shown)
    if limit is not None:
        first = first.orderBy("tipo_cdp", "serie", "numero", "fecha_emision").limit(limit)
    both = duplicates.select(F.lit(0).alias("prioridad"), *shown).unionByName(
        first.select(F.lit(1).alias("prioridad"), *shown))
    best = both.groupBy("tipo_cdp", "serie", "numero").agg(
        F.min(F.struct("prioridad", "fecha_emision", "importe_total")).alias("x"))
    return best.select("tipo_cdp", "serie", "numero", "x.*")


def attach_validity(rows: DataFrame, validity: DataFrame) -> DataFrame:
    """Left-join a status code per voucher and name it; vouchers never asked stay blank."""
    named = F.create_map(*[F.lit(x) for pair in VALIDITY.items() for x in pair])
    codes = validity.groupBy("tipo_cdp", "serie", "numero").agg(F.max("estado_cp").alias("estado_cp"))
    out = rows.join(codes, ["tipo_cdp", "serie", "numero"], "left")
    return out.withColumn("validez", F.coalesce(F.try_element_at(named, F.col("estado_cp")), "estado_cp", F.lit(""))).drop("estado_cp")


def latest_per_key(tickets: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Newest ticket per period among those younger than `hours`."""
    fresh = tickets.filter(F.col("creado") > now - F.make_interval(hours=F.lit(hours)))
    return fresh.groupBy("periodo").agg(F.max_by("ticket", "id").alias("ticket"))
