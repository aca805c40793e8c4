"""Sources and sinks: harvest pages, raw and processed tables, containers, models."""
