"""Data flows over the sample tables (``events``, ``customer``, ``orders``), one per operator."""
