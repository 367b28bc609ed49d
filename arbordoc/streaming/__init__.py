"""Extensions: streams of documents."""
