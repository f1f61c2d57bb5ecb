"""Binding of the derived views for one scale-factor directory."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from harvestry.functions import domains as D
from harvestry.functions.features import build_features
from harvestry.operators.joins import build_reference_lookup, merge_datasets
from harvestry.session import ensure_checkpoint_dir, fit_codegen_to_jit, hash_small_partitions, shared_path, write_parquet
from harvestry.sources import fixtures as FX


_CATALOGS: dict[tuple, "Catalog"] = {}


def catalog_for(spark: SparkSession, sf_dir: str) -> "Catalog":
    """The catalog of this session and folder, so that queries share its views and the written lookup."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    return _CATALOGS.setdefault(key, Catalog(spark, sf_dir))


class Catalog:
    """Lazily built DataFrames of the fixture views.

    Only ``lookup`` runs a job: the reference lookup is built and written once
    for each year range, at its first use, and read from there by every query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.tables = FX.Tables(spark, sf_dir)
        self._lookups: dict[tuple[int, int], DataFrame] = {}
        ensure_checkpoint_dir(spark)
        fit_codegen_to_jit(spark)
        hash_small_partitions(spark)

    def read(self, name: str) -> DataFrame:
        return self.tables.read(name)

    @cached_property
    def farm_obs(self) -> DataFrame:
        return FX.farm_obs(self.tables)

    @cached_property
    def ref_yield(self) -> DataFrame:
        return FX.ref_yield(self.tables)

    @cached_property
    def ref_pest(self) -> DataFrame:
        return FX.ref_pest(self.tables)

    @cached_property
    def ref_rain(self) -> DataFrame:
        return FX.ref_rain(self.tables)

    @cached_property
    def ref_temp(self) -> DataFrame:
        return FX.ref_temp(self.tables)

    def lookup(self, year_start: int, year_end: int) -> DataFrame:
        if (year_start, year_end) not in self._lookups:
            built = self._build_lookup(year_start, year_end)
            path = shared_path(self.spark, "lookup")
            write_parquet(built, path)
            self._lookups[year_start, year_end] = self.spark.read.schema(built.schema).parquet(path)
        return self._lookups[year_start, year_end]

    def _build_lookup(self, year_start: int, year_end: int) -> DataFrame:
        return build_reference_lookup(
            self.ref_yield, self.ref_pest, self.ref_rain, self.ref_temp,
            country_yield=FX.COUNTRY_LONG, country_pest=FX.COUNTRY_LONG,
            country_rain=FX.COUNTRY_SHORT, country_temp=FX.COUNTRY_SHORT,
            year_start=year_start, year_end=year_end)

    @cached_property
    def lookup_ref_year(self) -> DataFrame:
        return self.lookup(FX.REFERENCE_YEAR, FX.REFERENCE_YEAR)

    @cached_property
    def merged(self) -> DataFrame:
        return merge_datasets(self.farm_obs, self.lookup_ref_year)

    @cached_property
    def merged_keyed(self) -> DataFrame:
        """The merged table with the observation key in front."""
        return merge_datasets(self.farm_obs, self.lookup_ref_year, keep=FX.OBS_KEY)

    @cached_property
    def features(self) -> DataFrame:
        return build_features(self.merged)

    @cached_property
    def scenarios(self) -> DataFrame:
        return FX.scenarios(self.tables, self.farm_obs)

    @cached_property
    def coef(self) -> list[tuple[str, float, float, float]]:
        return FX.coef_rows()

    @property
    def intercept(self) -> float:
        return FX.COEF_INTERCEPT

    feature_names = D.FEATURES
