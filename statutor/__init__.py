"""A PySpark-native engine for auditing and curating a corpus of dated legal documents."""
