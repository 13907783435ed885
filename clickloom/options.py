"""Plain option objects: column roles, learner switches and FTRL hyper-parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ColumnRoles:
    """Which columns play which part.

    For headered data the entries are column names. For headerless data they are positions
    written as text ("0", "1", ...), and that text is also the category name that gets hashed.
    """

    target: str
    id: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()


@dataclass(frozen=True)
class LearnerOptions:
    """Switches of the online learner; without the hashing trick categories are numbered one by one."""

    # fixed values: defaults of the original job
    hash_trick: bool = True
    report_every: int = 100_000
    max_features: int = 4_000_000
    epochs: int = 2
    # share of the rows with label 0 that is learned, in percent; each then stands for 100 / share of them
    keep_negatives: int = 100


@dataclass(frozen=True)
class FtrlParams:
    """FTRL-Proximal hyper-parameters (McMahan et al. 2013)."""

    # fixed values: the settings of the original two-stage job
    l1: float = 1.1
    l2: float = 1.0
    alpha: float = 0.03
    beta: float = 1.0


@dataclass(frozen=True)
class BoostingParams:
    """Boosted-tree settings.

    The last three are Spark ML's for large inputs: node ids kept per row instead of the trees being walked
    again, how often these are checkpointed, and the memory for statistics, which bounds the nodes of one pass.
    """

    # fixed values: the settings of the original two-stage job
    trees: int = 30
    depth: int = 7
    learning_rate: float = 0.01
    bins: int = 120
    seed: int = 42
    cache_node_ids: bool = False
    checkpoint_interval: int = 10
    memory_mb: int = 256


# fixed value: a category value must occur this often to receive click-rate features
MIN_SUPPORT = 10

# fixed values: share of rows, in percent, that the hold-out split puts in the training part
TRAIN_PERCENT = 70
