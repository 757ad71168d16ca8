"""quillmark: retrieval, answer and corpus analytics as DataFrame operators."""
