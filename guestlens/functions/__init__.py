"""guestlens.functions"""
