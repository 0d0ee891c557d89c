"""Job settings. The defaults keep all rows; PUBLISHED has the settings of the published experiment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DataConfig:
    file_glob: str = "*.[cC][sS][vV]"
    sample_fraction: float = 1.0
    drop_duplicates: bool = True
    min_category_samples: int = 0


@dataclass(frozen=True)
class PreprocessConfig:
    test_size: float = 0.20
    validation_size: float = 0.10
    rfe_features: int = 30
    pca_variance: float = 0.95
    balance_classes: bool = True
    class_cap: int = 5000
    smote_neighbours: int = 5


@dataclass(frozen=True)
class ModelConfig:
    svc_c: float = 1.0
    svc_max_iter: int = 3000
    forest_trees: int = 400
    # Spark trees stop at depth 30.
    forest_depth: int = 30
    forest_cv_rows: int | None = None
    nu_grid: tuple[float, ...] = (0.05, 0.10, 0.20)
    max_benign_rows: int | None = None
    one_class_iterations: int = 60
    meta_c_grid: tuple[float, ...] = (0.1, 1.0, 10.0)
    meta_max_iter: int = 100
    isolation_trees: int = 200
    isolation_max_rows: int | None = None
    isolation_sample: int = 256


@dataclass(frozen=True)
class LoacoConfig:
    enabled: bool = True
    categories: tuple[str, ...] = (
        "DoS", "DDoS", "PortScan", "Brute Force", "Web Attack", "Bot",
    )


@dataclass(frozen=True)
class Config:
    seed: int = 42
    threshold: float = 0.5
    data: DataConfig = field(default_factory=DataConfig)
    preprocess: PreprocessConfig = field(default_factory=PreprocessConfig)
    models: ModelConfig = field(default_factory=ModelConfig)
    loaco: LoacoConfig = field(default_factory=LoacoConfig)


#: A fifth of the rows of each category, no categories of fewer than 1500 rows, and fits on samples of the rows.
PUBLISHED = Config(
    data=DataConfig(sample_fraction=0.20, min_category_samples=1500),
    models=ModelConfig(forest_cv_rows=20_000, max_benign_rows=80_000, isolation_max_rows=100_000),
)
