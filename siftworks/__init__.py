"""siftworks: a PySpark-native engine for searching, curating and preparing a catalogue of scientific datasets."""
