"""Sources and sinks: dataset JSON edge (D1/D2), native Parquet store (D3),
judged and triple imports (D4/D5), run store (D7), response store (Q6), and the
driver's test tables shaped into retrieval datasets."""
