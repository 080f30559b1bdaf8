"""panelcast: daily multi-series demand forecasting as Spark DataFrame plans."""

from panelcast.schema import PanelData, Settings

__all__ = ["PanelData", "Settings"]
