"""Spark-native analytics over many recordings of nanosecond-stamped time series."""

from .api.epochs import Epochs, construct_epochs_info, events_to_epochs_info
from .api.recording import Dataset, Recording
from .api.tables import Events, Stream

__version__ = "0.1.0"
__all__ = ["Dataset", "Epochs", "Events", "Recording", "Stream", "construct_epochs_info", "events_to_epochs_info"]
