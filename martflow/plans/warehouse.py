"""The warehouse over a folder of given tables, layer by layer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from martflow.operators import routing
from martflow.operators.first import first_days
from martflow.operators.joins import flat_sku
from martflow.plans import dwd, dws
from martflow.sources import replay
from martflow.sources.tables import Tables


class WindowTables(Mapping[str, DataFrame]):
    """The window tables by name, each planned when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]) -> None:
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


class Warehouse:
    """Facts, dimensions and window tables, all lazy."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.tables = Tables(spark, root)

    @cached_property
    def log(self) -> replay.Changes:
        """Change rows by table."""
        return replay.Changes(self.tables)

    @cached_property
    def mixed_log(self) -> DataFrame:
        return replay.change_log(self.tables)

    @cached_property
    def routed_log(self) -> DataFrame:
        """The mixed log of the tables that some fact route names; the routes are one row a table."""
        named = {r[0] for r in self.fact_config.select("source_table").distinct().collect()}
        return replay.change_log(self.tables, *[name for name in self.log if name in named])

    @cached_property
    def dictionary(self) -> DataFrame:
        return replay.dictionary(self.tables)

    @cached_property
    def flat_sku(self) -> DataFrame:
        t = self.tables
        return flat_sku(
            replay.sku(t), replay.spu(t), replay.trademark(t),
            replay.category3(t), replay.category2(t), replay.category1(t),
        )

    @cached_property
    def raw_page(self) -> DataFrame:
        """Page records as logged."""
        return replay.traffic(self.tables).where("page_id IS NOT NULL")

    @cached_property
    def first_days(self) -> DataFrame:
        """First day of each device, over the whole behaviour log."""
        return first_days(replay.traffic(self.tables))

    @cached_property
    def detail_lines(self) -> DataFrame:
        """Order lines with repeated versions, columns of their own table only."""
        return dwd.detail_rows(self.log)

    @cached_property
    def detail_versions(self) -> DataFrame:
        """Order lines with repeated versions, as an upsert log delivers them."""
        return dwd.join_order_detail(dwd.order_detail_parts(self.log))

    @cached_property
    def order_detail(self) -> DataFrame:
        return dwd.order_detail(self.log)

    @cached_property
    def cart_add(self) -> DataFrame:
        return dwd.cart_add(self.log)

    @cached_property
    def pay_detail(self) -> DataFrame:
        return dwd.pay_detail(self.log, self.dictionary)

    @cached_property
    def refund(self) -> DataFrame:
        return dwd.refund(self.log, self.dictionary)

    @cached_property
    def fact_config(self) -> DataFrame:
        return routing.active_config(replay.fact_config(self.tables), "DWD")

    @cached_property
    def dimension_config(self) -> DataFrame:
        return routing.active_config(replay.dimension_config(self.tables), "DIM")

    @cached_property
    def windows(self) -> WindowTables:
        t = self.tables
        return WindowTables({
            "keyword": lambda: dws.keyword(replay.searches(t)),
            "traffic": lambda: dws.traffic(self.raw_page, self.first_days),
            "home_detail": lambda: dws.home_detail(self.raw_page),
            "user_login": lambda: dws.user_login(self.raw_page),
            "user_register": lambda: dws.user_register(dwd.register(self.log)),
            "cart_add_uu": lambda: dws.cart_add_uu(self.cart_add),
            "payment_suc": lambda: dws.payment_suc(dwd.paid_lines(self.log, self.order_detail)),
            "order": lambda: dws.order(self.detail_versions),
            "sku_order": lambda: dws.sku_order(self.detail_lines, self.flat_sku),
            "province_order": lambda: dws.province_order(
                self.detail_versions, replay.province(t)),
            "refund": lambda: dws.refund(self.refund, self.flat_sku),
        })
