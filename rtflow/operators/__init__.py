from rtflow.operators.joins import JoinSpec, join_static, join_windowed
from rtflow.operators.projection import project
from rtflow.operators.windows import WindowSpec, window_aggregate

__all__ = ["JoinSpec", "WindowSpec", "join_static", "join_windowed", "project", "window_aggregate"]
