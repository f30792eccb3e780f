"""motioncheck: a PySpark analytics engine for recorded and predicted road-agent motion."""
